"""Text features as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that count as a sign of quantities, and section names with the weight of their chunks,
#: in the order in which they are tried.
UNITS = (
    "mm cm m km ha m2 km2 kg g t °c c k % mm/yr cm/yr m/s w/m2 gpp gt tg mg µm um nm ppm ppb yr yr-1 day days year years ndvi lai et"
).split()
SECTION_WEIGHTS = (
    ("methods", 1.5), ("method", 1.5), ("materials and methods", 1.5), ("data and methods", 1.5), ("study area", 1.2), ("experiment", 1.4),
    ("results", 1.5), ("result", 1.5), ("discussion", 1.3), ("analysis", 1.3), ("conclusion", 1.1), ("conclusions", 1.1), ("abstract", 1.0),
    ("introduction", 0.6), ("background", 0.7), ("references", 0.2), ("bibliography", 0.2), ("acknowledg", 0.2), ("appendix", 0.9), ("unknown", 1.0),
)
#: Words, numbers that are not glued to letters, and numbered headings.
TOKEN = "[a-z][a-z0-9\\-]{1,}"
NUMBER = "(?i)(?<![A-Za-z_])-?[0-9]+(?:[.,][0-9]+)?(?:e[+-]?[0-9]+)?(?![A-Za-z_])"

NUMBERED_HEADING = r"^(?:[0-9IVX]+\.?[0-9\.]*)\s+([A-Z][A-Za-z /\\-]{2,60})$"


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more that begin with a letter."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_counts(rows: DataFrame, words: str) -> DataFrame:
    """One row (term, c) for each different word of the array, which has ``len`` words in all, beside the other columns.

    Counted within the row, without a shuffle: words are sorted and cut where they change. No words, no rows.
    """
    rest = [c for c in rows.columns if c != words]
    got = rows.select(*rest, F.sort_array(words).alias("__s"))
    begins = F.filter(F.transform("__s", lambda x, i: F.when((i == 0) | (x != F.get("__s", i - 1)), i)), lambda i: i.isNotNull())
    got = got.select(*rest, "__s", F.size("__s").alias("len"), begins.alias("__b"))
    runs = F.transform("__b", lambda b, j: F.struct(F.get("__s", b).alias("term"), (F.coalesce(F.get("__b", j + 1), F.col("len")) - b).alias("c")))
    return got.select(*rest, "len", F.inline(runs))


def est_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def work_id(uri: Column) -> Column:
    """Last path segment of a works address if it begins with W, else null."""
    last = F.substring_index(F.rtrim(uri, F.lit("/")), "/", -1)
    return F.when(uri.contains("openalex.org") & last.startswith("W"), last)


def numeric_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NUMBER))


def unit_hits(text: Column) -> Column:
    """How many of the units occur among the tokens."""
    return F.size(F.array_intersect(tokens(text), F.array(*[F.lit(u) for u in UNITS])))


def detect_heading(line: Column) -> Column:
    """Name of the section that a line opens, else null."""
    core = F.trim(F.coalesce(line, F.lit("")), F.lit(" .:"))
    numbered = F.regexp_extract(core, NUMBERED_HEADING, 1)
    low = F.trim(F.lower(F.when(numbered != "", numbered).otherwise(core)))
    names = "|".join(name for name, _ in SECTION_WEIGHTS if name != "unknown")
    opening = F.nullif(F.regexp_extract(low, f"^({names})", 1), F.lit(""))  # the first name in order that fits
    loud = (core == F.upper(core)) & (core != F.lower(core)) & F.length(core).between(3, 60) & ~core.endswith(".")
    inside = F
    for name, _ in SECTION_WEIGHTS:
        inside = inside.when(F.lower(core).contains(name), F.lit(name))
    blank = (F.length(line) == 0) | (F.length(line) > 90) | line.isNull()
    return F.when(~blank, F.coalesce(opening, F.when(loud, inside)))


def section_weight(section: Column) -> Column:
    low = F.lower(F.coalesce(section, F.lit("unknown")))
    out = None
    for name, weight in SECTION_WEIGHTS:
        out = (F if out is None else out).when(low.startswith(name), F.lit(weight))
    return out.otherwise(F.lit(1.0))


def abstract_preview(abstract: Column, most: int = 1400) -> Column:
    text = F.coalesce(abstract, F.lit("No abstract"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def any_contains(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_contains(text: Column, words) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


#: Fixed values of the heuristic profile.
TYPE_PATTERNS = (
    ("definition", r"\b(what is|define|definition of|meaning of)\b"),
    ("mechanism", r"\b(how does|how do|mechanism|why does|explain why)\b"),
    ("comparison", r"\b(compare|versus|vs\.?|differ|difference between|contrast)\b"),
    ("quantitative", r"\b(how much|how many|what fraction|percentage|percent|rate of|by how|trend|over the past|between [0-9]{4}|since [0-9]{4}|by [0-9]{4})\b"),
    ("method_eval", r"\b(how effective|how accurate|evaluate|performance|precision|accuracy|validate|compare methods)\b"),
    ("application", r"\b(applied|application|used in|use case|used for)\b"),
)
ACTING = "work affect cause influence interact drive trigger".split()
PLACES = "arctic antarctic europe africa asia amazon mediterranean pacific atlantic sahel tropics north south region country".split()
METHODS = "method approach technique algorithm model framework".split()
CHECKS = "validate validation uncertainty error calibration".split()
AMOUNTS = "% percent fraction rate trend magnitude amount volume".split()
JOINERS = [" and ", " or ", " while ", " whereas ", " however ", " but "]


def _says(text: Column, alternatives: str) -> Column:
    """Whether one of the alternatives, parted by bars, stands in the text between word borders.

    As ``rlike`` of them all together, but a text without an alternative's opening letters, as most are, is
    passed over by ``contains``, and the border before these letters is looked at only where they are.
    """
    out = F.lit(False)
    for one in alternatives.split("|"):
        opening = re.match(r"[a-z ]+", one)[0]
        out = out | (text.contains(opening) & text.rlike(rf"{opening}(?<=\b{opening}){one[len(opening):]}\b"))
    return out


def with_profile(rows: DataFrame, question: str) -> DataFrame:
    """Adds profile columns from surface features of a question.

    The small letters and the question's type, which others are made of, are columns of their own, so that each is worked out once a row.
    """
    rest = rows.columns
    rows = rows.withColumn("__q", F.lower(F.coalesce(question, F.lit(""))))
    q = F.col("__q")
    kind = F
    for name, pattern in TYPE_PATTERNS:
        test = _says(q, pattern.removeprefix(r"\b(").removesuffix(r")\b"))
        kind = kind.when(test & any_contains(q, ACTING) if name == "mechanism" else test, F.lit(name))
    rows = rows.withColumn("question_type", kind.otherwise(F.lit("continuous")))
    hits = q.rlike(r"[0-9](?<=\b[0-9])[0-9]{1,3}\b").cast("int") + any_contains(q, AMOUNTS).cast("int")
    hits = hits + (F.col("question_type") == "quantitative").cast("int")
    joined = sum((((F.length(q) - F.length(F.replace(q, F.lit(w), F.lit("")))) / len(w)).cast("int") for w in JOINERS), F.lit(0))
    words = F.regexp_count(q, F.lit(r"\S+"))
    depth = F.when(any_contains(q, METHODS), 0.5).otherwise(0.1) + F.when(any_contains(q, CHECKS), 0.3).otherwise(0.0)
    temporal = 0.1 + F.when(q.rlike(r"[12](?<=\b[12])(?:(?<=1)9|(?<=2)0)[0-9]{2}\b"), 0.4).otherwise(0.0)
    temporal = temporal + F.when(_says(q, "decade|past [0-9]+ years|since|between [0-9]{4}"), 0.3).otherwise(0.0)

    def score(x: Column) -> Column:
        return F.bround(F.least(F.lit(1.0), x), 2)

    found = {
        "complexity": score(0.25 + 0.015 * words + 0.1 * joined),
        "quantitativity": score(0.15 + 0.25 * hits),
        "spatial_specificity": score(0.1 + 0.25 * count_contains(q, PLACES)),
        "temporal_specificity": score(temporal),
        "methodological_depth": score(depth),
        "confidence": F.lit(0.85),
    }
    return rows.select(*[f"`{c}`" for c in rest], "question_type", *[c.alias(n) for n, c in found.items()])
