"""Names of places in listing texts as Columns: spelling, candidates in order of how exact they are, map links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwise.functions.text import norm

# Latin spellings of one Cyrillic letter, the longer first, then letters one by one.
SPELLED = (("dzh", "џ"), ("dz", "џ"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("kj", "ќ"), ("gj", "ѓ"), ("lj", "љ"), ("nj", "њ"))
FROM, TO = "abcčćdefghijklmnoprsštuvzž", "абцчќдефгхијклмнопрсштувзж"
# Words and short forms before a place; words that are no place.
BEFORE = ("во", "vo", "на", "na", "кај", "kaj", "до", "do", "под", "pod", "с\\.", "s\\.", "село", "selo", "нас\\.", "nas\\.", "населба", "naselba")
NO_PLACE = ("centar", "grad", "blizina", "skopje", "plac", "odlicna", "naselba", "vikend", "kuka", "kukja", "stan", "vikendica", "vila", "imot", "zemjiste", "parcela", "niva", "lozje", "prodavam", "izdavam", "itno", "placevi", "placot", "hitno", "ekskluzivno", "nova", "nov")
CAPITAL, LETTERS = "A-ZА-ШЃЌЅЈЉЊЏ", "A-Za-zА-Ша-шЃЌЅЈЉЊЏѓќѕјљњџšžčć"
# First words of two-word names of cadastral areas.
FIRST_WORDS = ("долно", "горно", "ново", "старо", "мало", "големо", "долни", "горни", "нова", "стара", "мали", "големи")
COUNTRY = "North Macedonia"


def to_cyrillic(word: Column) -> Column:
    """A name in Latin letters spelled in Cyrillic, with a capital; as it is if it has a Cyrillic letter."""
    letters = F.translate(reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLED, F.lower(word)), FROM, TO)
    return F.when(F.lower(word).rlike("[а-шѓќѕјљњџ]"), word).otherwise(F.concat(F.upper(F.left(letters, F.lit(1))), F.substr(letters, F.lit(2))))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def is_place_word(word: Column) -> Column:
    return ~F.trim(norm(word)).isin(*NO_PLACE)


def title_place(title: Column) -> Column:
    """The word after the first preposition of place; null if there is none or it is no place."""
    pattern = rf"(?iuU)\b(?:{'|'.join(BEFORE)})\s*(?:с\.|s\.|село|selo)?\s*([{LETTERS}][\w\-]{{2,}})"
    word = F.nullif(F.regexp_extract(title, pattern, 1), F.lit(""))
    return F.when(is_place_word(word), to_cyrillic(word))


def title_names(title: Column, city: Column, most: int = 5) -> Column:
    """The first capitalised words of a title, without words that are no place and the city itself."""
    words = F.slice(F.regexp_extract_all(title, F.lit(rf"(?U)\b([{CAPITAL}][{LETTERS}]{{3,}})\b"), F.lit(1)), 1, most)
    written = F.transform(words, lambda w: F.when(F.substr(w, F.lit(2)) == F.lower(F.substr(w, F.lit(2))), w).otherwise(capitalised(w)))
    return F.transform(F.filter(written, lambda w: is_place_word(w) & ~w.eqNullSafe(city)), to_cyrillic)


def cadastral_area(note: Column) -> Column:
    """The cadastral area that a notice names after КО: its first word, and the second after an adjective."""
    rest = F.regexp_extract(F.coalesce(note, F.lit("")), r"(?U)\bКО\s+(.+)", 1)
    words = F.filter(F.split(rest, r"(?U)[\s,.;:()–-]+"), lambda w: w != "")
    first, second = F.get(words, 0), F.get(words, 1)
    two = F.lower(first).isin(*FIRST_WORDS) & second.isNotNull()
    return F.when(first.rlike(r"^\p{L}"), F.when(two, F.concat_ws(" ", capitalised(first), capitalised(second))).otherwise(capitalised(first)))


def candidates(title: Column, named: Column, note: Column, address: Column, district: Column, city: Column, prefix: str = "Скопје ") -> Column:
    """Names to look up, the most exact first: the place after a preposition, capitalised words, ``named`` places of the text (an array), the
    cadastral area, a short address, the district without the ``prefix``, the city. Each once; missing ones are left out."""
    title, address = F.coalesce(title, F.lit("")), F.trim(F.coalesce(address, F.lit("")))
    short = (address != "") & (F.size(F.split(address, r"(?U)\s+")) <= 3) & ~address.rlike(r"(?U)\d")
    parts = F.concat(F.array(title_place(title)), title_names(title, city), F.coalesce(named, F.array().cast("array<string>")), F.array(cadastral_area(note), F.when(short, to_cyrillic(address)), F.replace(district, F.lit(prefix), F.lit("")), city))
    return F.array_distinct(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""))


def map_query(address: Column, note: Column, district: Column, city: Column, prefix: str = "Скопје ") -> Column:
    """What to search a map for without a pin: the address, or the cadastral area, then the district, the city and the country; null without any."""
    address = F.trim(F.coalesce(address, F.lit("")))
    street = F.when((address != "") & ~address.rlike(r"^(?U)[\d\s.,/-]*$"), address)
    area = F.when(street.isNull() & (F.lower(cadastral_area(note)) != F.lower(F.coalesce(city, F.lit("")))), cadastral_area(note))
    near = F.when(F.startswith(district, F.lit(prefix)), F.replace(district, F.lit(prefix), F.lit(""))).when(~district.eqNullSafe(city), F.nullif(district, F.lit("")))
    parts = F.array_compact(F.array(street, area, near, F.nullif(city, F.lit(""))))
    return F.when(F.size(parts) > 0, F.array_join(F.array_distinct(F.array_append(parts, F.lit(COUNTRY))), ", "))


def map_url(lat: Column, lng: Column, query: Column) -> Column:
    """A map link to the pin, else to the search."""
    top = "https://www.google.com/maps/search/?api=1&query="
    pinned = (F.coalesce(lat, F.lit(0.0)) != 0) & (F.coalesce(lng, F.lit(0.0)) != 0)
    return F.when(pinned, F.concat(F.lit(top), F.format_string("%.6f,%.6f", lat, lng))).when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit(top), F.url_encode(query)))
