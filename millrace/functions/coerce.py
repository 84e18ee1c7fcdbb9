"""Cells of text to typed values: numbers, times, units, durations, bands.

Everything here is a Column expression, so it runs inside generated code and is
pushed through projections like any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings that count as a number or a time.
PLAIN_NUMBER = r"^-?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?$"
DOTTED_NUMBER = r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"
COMMA_NUMBER = r"^-?[0-9]+,[0-9]+$"
ISO_TIME = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
DAY_FIRST_TIME = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?$"
#: Accented letters and what they are without the accent.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"
#: Spellings of units that mean the same.
UNIT_ALIASES = {
    "degf": "f", "fahrenheit": "f", "degc": "c", "celsius": "c", "tons": "ton", "tonnes": "ton", "t": "ton", "pct": "%", "percent": "%",
    "galh": "gal/h", "categoria": "", "category": "", "regla": "", "rule": "", "marcha": "", "gear": "",
}
#: Seconds in the unit of a rate's denominator.
RATE_SECONDS = {"h": 3600, "hr": 3600, "hour": 3600, "min": 60, "s": 1, "sec": 1}


def parse_number(text: Column) -> Column:
    """A number in one of three spellings, else null.

    1,234.5 and 1234.5; 1.234.567,8; 12,5. Exponents, leading plus and words are
    not numbers, so a plain cast would accept too much.
    """
    s = F.trim(text)
    plain = F.regexp_replace(s, ",", "")
    dotted = F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")
    comma = F.regexp_replace(s, ",", ".")
    return F.when(s.rlike(PLAIN_NUMBER), plain.cast("double")).when(s.rlike(DOTTED_NUMBER), dotted.cast("double")).when(s.rlike(COMMA_NUMBER), comma.cast("double"))


def parse_time(text: Column) -> Column:
    """An ISO or day-first time, else null. Offsets and fractions are dropped."""
    s = F.trim(text)

    def stamp(pattern: str, year: int, month: int, day: int) -> Column:
        part = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(s, pattern, i), F.lit("")), F.lit("0")), 2, "0")
        date = F.concat_ws("-", F.regexp_extract(s, pattern, year), part(month), part(day))
        return F.try_to_timestamp(F.concat(date, F.lit(" "), F.concat_ws(":", part(4), part(5), part(6))), F.lit("yyyy-MM-dd HH:mm:ss"))

    return F.when(s.rlike(ISO_TIME), stamp(ISO_TIME, 1, 2, 3)).when(s.rlike(DAY_FIRST_TIME), stamp(DAY_FIRST_TIME, 3, 2, 1)).cast("timestamp_ntz")


def cell_kind(text: Column) -> Column:
    """blank, number, time or text. Numbers are tried before times."""
    s = F.trim(text)
    return F.when(text.isNull() | (s == ""), "blank").when(parse_number(text).isNotNull(), "number").when(s.rlike(ISO_TIME) | s.rlike(DAY_FIRST_TIME), "time").otherwise("text")


def without_accents(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), ACCENTED, PLAIN)


def word_list(text: Column) -> Column:
    """The words of a name; an underscore joins."""
    return F.split(without_accents(text), "[^a-z0-9_]+")


def has_word(words: tuple[str, ...], text: Column) -> Column:
    return F.arrays_overlap(word_list(text), F.array(*map(F.lit, words)))


def words_only(text: Column) -> Column:
    """Without accents, and with a space for each run of anything else."""
    return F.trim(F.regexp_replace(without_accents(text), "[^a-z0-9]+", " "))


def squash(text: Column) -> Column:
    return F.regexp_replace(without_accents(text), "[^a-z0-9]+", "")


def slug(text: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(words_only(text), " ", "-"), 1, most)


def split_unit(name: Column) -> Column:
    """struct(label, unit) of `label (unit)` or `label [unit]`."""
    s = F.trim(F.regexp_replace(F.regexp_replace(name, "[▲▼↑↓*•]+", " "), r"\s+", " "))
    pattern = r"^(.*?)\s*[(\[]([^)\]]{0,14})[)\]]$"
    label, unit = F.trim(F.regexp_extract(s, pattern, 1)), F.trim(F.regexp_extract(s, pattern, 2))
    found = label != ""
    return F.struct(F.when(found, label).otherwise(s).alias("label"), F.when(found & (unit != ""), unit).alias("unit"))


def declared_role(header: Column) -> Column:
    """The role that a header's prefix declares (time:, who:, ctx:, val:), else null."""
    s = F.lower(F.trim(header))
    return F.nullif(F.when(s == "time", F.lit("time")).otherwise(F.regexp_extract(s, r"^(time|who|ctx|val)\s*:", 1)), F.lit(""))


def parse_persistence(text: Column) -> Column:
    """struct(sec, note): a duration with a unit of seconds, minutes or hours."""
    s = F.trim(text)
    number = F.regexp_extract(s, r"([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.lower(F.regexp_extract(s, r"[0-9]+(?:\.[0-9]+)?\s*([A-Za-z]?)", 1))
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    found = number != ""
    sec = F.when(found, F.floor(number.cast("double") * factor + 0.5).cast("long"))
    return F.struct(sec.alias("sec"), F.when(~found | s.rlike("^[<>]"), F.nullif(s, F.lit(""))).alias("note"))


def parse_bands(text: Column) -> Column:
    """struct(ranges, labels) of texts like `4-12`, `>18`, `<3 o >15`, `Good / Fair`."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    two, one, alone = rf"^([<>]=?)?\s*{number}\s*-\s*{number}$", rf"^([<>]=?)\s*{number}", rf"^{number}$"
    parts = F.filter(F.transform(F.split(F.trim(text), r"(?i)\s+(?:o|or|/|\|)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    get = lambda p, pattern, i: F.regexp_extract(p, pattern, i).try_cast("double")

    def band(p: Column) -> Column:
        is_two, is_one = p.rlike(two), p.rlike(one)
        up = is_one & p.startswith(">")
        lo = F.when(is_two, get(p, two, 2)).when(up, get(p, one, 2)).when(is_one, F.lit(None)).otherwise(get(p, alone, 1))
        hi = F.when(is_two, get(p, two, 3)).when(up, F.lit(None)).when(is_one, get(p, one, 2)).otherwise(get(p, alone, 1))
        strict = lambda sign: p.startswith(sign) & ~p.startswith(f"{sign}=")
        return F.struct(lo.alias("lo"), hi.alias("hi"), strict(">").alias("exLo"), (strict("<") & ~is_two).alias("exHi"))

    ranged = lambda p: p.rlike(two) | p.rlike(one) | p.rlike(alone)
    return F.struct(F.transform(F.filter(parts, ranged), band).alias("ranges"), F.filter(parts, lambda p: ~ranged(p)).alias("labels"))


def unit_key(unit: Column) -> Column:
    """One spelling for each unit; units that say nothing become empty."""
    s = F.regexp_replace(without_accents(unit), "[^a-z0-9/%]+", "")
    aliases = F.create_map(*(F.lit(x) for kv in UNIT_ALIASES.items() for x in kv))
    return F.coalesce(aliases[s], s)


def units_agree(a: Column, b: Column) -> Column:
    """Equal, or one of them says nothing."""
    x, y = F.coalesce(unit_key(a), F.lit("")), F.coalesce(unit_key(b), F.lit(""))
    return (x == "") | (y == "") | (x == y)


def rate_seconds(unit: Column) -> Column:
    """Seconds in the denominator of a rate such as gal/h, else null."""
    per = F.regexp_extract(F.lower(F.trim(unit)), r"^.+?\s*/\s*(h|hr|hour|min|s|sec)$", 1)
    return F.create_map(*(F.lit(x) for kv in RATE_SECONDS.items() for x in kv))[per]


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """`{{key}}` replaced by its value; unknown keys stay."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def iso_text(ts: Column) -> Column:
    """A time as ISO text in whole seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def spaced(text: Column) -> Column:
    """Lower case, with one space for each run of white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def letters_only(text: Column) -> Column:
    """Lower case, with a space for each run of anything but a-z and digits; accented
    letters are not read as plain ones."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _short(x: Column) -> Column:
    """A number to three decimals, without a trailing .0"""
    return F.regexp_replace((F.floor(x * 1000.0 + 0.5).cast("double") / 1000.0).cast("string"), r"\.0$", "")


def grain_label(seconds: Column) -> Column:
    """A step of time in its largest unit."""
    in_unit = lambda size, name: F.concat(_short(seconds / size), F.lit(f" {name}"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "irregular").when(seconds < 60, in_unit(1, "s")).when(seconds < 3600, in_unit(60, "min")).when(seconds < 86400, in_unit(3600, "h")).otherwise(in_unit(86400, "d"))


def span_label(seconds: Column) -> Column:
    """A length of time in words: minutes up to 90, hours up to 48, then days."""
    minutes = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)).cast("long").cast("string")
    tenth = lambda size: _short(F.floor(seconds / size + 0.5) / 10)
    return F.when(seconds < 5400, F.concat(minutes, F.lit(" minutes"))).when(seconds < 172800, F.concat(tenth(360), F.lit(" hours"))).otherwise(F.concat(tenth(8640), F.lit(" days")))


def counted_facts(text: Column, most: int = 12) -> Column:
    """array(struct(n, label)) of phrases such as `25 trucks`; a label's first counts."""
    pattern = r"(\d[\d.,]*)\s+([A-Za-zÁÉÍÓÚáéíóúÑñ]{3,21})"
    numbers, labels = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    pairs = F.filter(F.zip_with(numbers, labels, lambda n, w: F.struct(parse_number(n).alias("n"), w.alias("label"))), lambda f: f["n"].isNotNull())
    first = F.filter(pairs, lambda f, i: F.array_position(F.transform(pairs, lambda g: without_accents(g["label"])), without_accents(f["label"])) == i + 1)
    return F.slice(first, 1, most)


#: What a destination of each type of channel looks like.
DESTINATIONS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "sms": r"^[+()\d][\d\s\-().]{5,}$",
    "call": r"^[+()\d][\d\s\-().]{5,}$",
    "slack": r"^https?://|^#?[\w-]{2,}$",
    "webhook": r"^https?://.+",
}


def destination_ok(kind: Column, destination: Column) -> Column:
    """Whether a destination fits its type of channel; null for an unknown type."""
    checked = None
    for name, pattern in DESTINATIONS.items():
        checked = F.when(kind == name, destination.rlike(pattern)) if checked is None else checked.when(kind == name, destination.rlike(pattern))
    return checked


#: What a column of people, or of items, is named after: parts of a name,
#: ends of a word, whole words.
PERSON_PARTS, PERSON_ENDS = ("operator", "operador", "driver", "conductor", "employee", "person"), ("who",)
ITEM_PARTS, ITEM_WORDS = ("truck", "camion", "vehicle", "vehiculo", "equipo", "machine", "item", "product"), ("unit", "sku")


def kind_of_column(name: Column) -> Column:
    """person, item or cohort, by a column's name."""
    plain = without_accents(F.coalesce(name, F.lit("")))
    holds = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(plain, x))
    ends = F.exists(word_list(plain), lambda w: F.exists(F.array(*map(F.lit, PERSON_ENDS)), lambda x: F.endswith(w, x)))
    return F.when(holds(PERSON_PARTS) | ends, "person").when(holds(ITEM_PARTS) | has_word(ITEM_WORDS, plain), "item").otherwise("cohort")


#: Units of each kind of measure.
UNITS_OF_KIND = {"percentage": ("%",), "duration": ("h", "hr", "hrs", "hour", "s", "sec", "min", "d", "day"), "money": ("usd", "eur", "$")}


def kind_of_measure(unit: Column) -> Column:
    """percentage, duration, money or count, by a measure's unit."""
    kinds = F.create_map(*(F.lit(x) for kind, units in UNITS_OF_KIND.items() for u in units for x in (u, kind)))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.coalesce(unit, F.lit("")))), F.lit("count"))


#: How each kind of answer is written.
KIND_FORMATS = {"money": "currency", "count": "count", "percentage": "percentage", "duration": "time"}


def format_of_kind(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in KIND_FORMATS.items() for x in kv))[kind], F.lit("count"))


def declared_format(declared: Column, suggested: Column) -> Column:
    """A valid declared format counts more than one suggested by the name."""
    return F.when(declared.isin(*KIND_FORMATS.values()), declared).otherwise(suggested)
