"""Text functions as column expressions: normal forms, tokens, ids, decay, intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker phrases of the three intents, German and English.
SUPERSEDES = (
    "ersetzt", "ersetzt durch", "ersatz", "ablöst", "löst ab", "abgelöst", "supersedes", "superseded", "replaces",
    "replaced by", "obsolet", "obsolete", "deprecated", "statt", "anstelle von", "instead of",
)
CONTRADICTS = (
    "ist nicht", "nicht mehr", "keineswegs", "widerspricht", "widersprochen", "keine", "kein", "niemals", "nie", "ist falsch",
    "falsch", "falsche", "is not", "no longer", "never", "not true", "false", "wrong", "contradicts",
)
CONTINUES = (
    "setzt fort", "basiert auf", "aufbauend", "weiterentwicklung", "weiterentwickelt", "verfeinert", "erweitert um", "fortgeführt",
    "builds on", "based on", "extends", "extends with", "continues", "continued", "refines", "follows from",
)
# Markers whose object must be shared, and function words in German and English.
OBJECT_MARKERS = ("keine", "kein", "nie", "niemals", "statt", "falsch", "falsche", "no", "never", "false", "wrong")
STOP_WORDS = """
    die der das und ist ein eine einer eines mit von für auf den dem aus bei
    als wie nur auch sich nicht keine kein sind wird werden wurde sein ihre
    ihren ihrer diesem diese dieses dieser gegen über unter zwischen ohne weil
    dass durch zum zur im am in an wir ich du er sie es war hat habe haben
    dann wenn so aber oder noch nach vor hier da bitte würde können sollen
    muss worden indem obwohl deshalb trotz außer sowohl sowie bspw z.b bzw
    the and is are with for on of a an to in not no this that but or as was
    were been has have it its be been can will would should must shall may
    """.split()
PRIORITY = {"supersedes": SUPERSEDES, "contradicts": CONTRADICTS, "continues": CONTINUES}


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def umlaut_fold(text: Column) -> Column:
    for letter, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return text


def snippet(text: Column, size: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def fingerprint(query: Column) -> Column:
    return F.substring(F.sha1(normalized(query)), 1, 10)


def summary_id(ids: Column) -> Column:
    return F.concat(F.lit("c"), F.substring(F.sha1(F.array_join(F.sort_array(ids), "|")), 1, 11))


def weibull(age_days: Column, scale: float = 30.0, shape: float = 1.5) -> Column:
    return F.when(age_days <= 0, 1.0).otherwise(F.exp(-F.pow(age_days / scale, F.lit(shape))))


def retention(recalls: Column) -> Column:
    return F.when(recalls <= 0, 0.0).otherwise(1 - F.exp(-recalls / 10.0))


def degradation_level(score: Column) -> Column:
    return F.when(score >= 0.6, "record").when(score >= 0.4, "summary").when(score >= 0.2, "gist").otherwise("tombstone")


def escaped(text: Column) -> Column:
    """For table cells: a backslash before what Markdown or HTML would read."""
    for sign in "|<>&":
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return text


def cell(text: Column, size: int) -> Column:
    """A snippet, cut first and escaped then, so that no escape is cut in half."""
    return escaped(snippet(F.coalesce(text, F.lit("")), size))


def body(text: Column) -> Column:
    """What follows a head between lines of ---, or the whole text."""
    after = F.regexp_extract(text, r"(?s)\A---\n.*?\n---\n\n?(.*)\z", 1)
    return F.trim(F.when(text.startswith("---\n") & text.rlike(r"(?s)\A---\n.*?\n---\n"), after).otherwise(text))


def _seconds(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO stamp; one without a zone is in UTC, whatever the session's zone."""
    zoned = stamp.rlike(r"\d:\d\d.*([A-Za-z]|[+-]\d\d(:?\d\d)?)\s*$")
    day = stamp.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$")
    at = F.when(zoned, stamp).when(day, F.concat(F.trim(stamp), F.lit("T00:00:00Z"))).otherwise(F.concat(F.trim(stamp), F.lit("Z")))
    return F.unix_timestamp(F.try_to_timestamp(at))


def parsed(stamp: Column, missing: Column) -> Column:
    """Seconds since 1970 of an ISO stamp (UTC where it names no zone); ``missing`` where it is none."""
    return F.coalesce(_seconds(stamp), missing)


def age_days(created: Column, now_s: int) -> Column:
    """Age of an ISO stamp in days; 0 if it can't be read."""
    return F.coalesce((F.lit(now_s) - _seconds(created)) / 86400.0, F.lit(0.0))


def decay_level(recalls: Column, age: Column) -> Column:
    """Level of retention times decay."""
    return degradation_level(retention(recalls) * weibull(age))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence < 0.45), "none").when(confidence < 0.75, "low").when(confidence < 0.95, "mid").otherwise("auto")


#: Kinds that older files name in German.
OLD_KINDS = {"aehnlich": "similar", "ähnlich": "similar", "erweitert": "extends", "kontradiktorisch": "contradicts"}


def migrated_kind(kind: Column) -> Column:
    out = kind
    for old, new in OLD_KINDS.items():
        out = F.when(kind == old, new).otherwise(out)
    return out


def origin_of(kind: Column, confidence: Column) -> Column:
    return F.when(kind.isin(*PRIORITY), "intent").when(confidence.isNotNull(), "suggester").otherwise("manual")
