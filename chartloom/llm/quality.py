"""Quality rules: one threshold table compiled into one projection.

Every rule compares a count with a share of another count, in whole numbers, so
the verdict is the same on every engine.  Nothing is shuffled and no user
function runs; the cost is a few passes over each text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import SPACE, fresh, let, shingle_hashes, table, whole, word_hashes, words

WINDOW = 8

#: frequent function words of the four languages
STOP_WORDS = (
    "the of and to in is was for that with on it as at by are be this from or an a "
    "der die das und zu den von ist mit im ein eine nicht auf für in es "
    "le la les de des et un une en que qui dans pour sur est au du "
    "el los las y una por con su para se"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= 100 * part / whole <= high`` (a bound of None is open)."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


#: percentages; e.g. a mean word length from 2 to 20 characters is 200 to 2000 percent
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=2000),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("exclamations", "n_exclaims", "n_words", high=30),
    Rule("capitals", "n_capitals", "word_chars", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=30),
)

MIN_WORDS, MAX_REPEATED = 20, 30


def _covered(hashes: Column, width: int) -> Column:
    """How many positions lie in a window whose hash occurs twice or more."""

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        positions = let(ordered, repeated)
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(
            positions,
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")),
        )["n"]

    return let(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(count(h)))


def _stop_count(found: Column) -> Column:
    spelled = sorted(set(STOP_WORDS) | {w.capitalize() for w in STOP_WORDS} | {w.upper() for w in STOP_WORDS})
    return F.size(F.filter(found, lambda w: w.isin(spelled)))


def quality_counts(text: Column) -> dict[str, Column]:
    """The counts that rules may name, as one struct's fields."""
    text = whole(text)

    def line_counts(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(f"^[{SPACE}]*[-*•]"))).alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))).alias("n_cut_lines"),
        )

    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)

    def word_counts(found: Column) -> Column:
        return F.struct(
            F.size(found).alias("n_words"),
            F.length(F.array_join(found, "")).alias("word_chars"),
            _stop_count(found).alias("n_stop_words"),
            _covered(shingle_hashes(word_hashes(found), WINDOW), WINDOW).alias("n_repeat_words"),
        )

    return {
        "words": let(words(text), word_counts),
        "lines": let(with_word, line_counts),
        "marks": F.struct(
            F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("n_symbols"),
            F.regexp_count(text, F.lit("!")).alias("n_exclaims"),
            F.regexp_count(text, F.lit("\\p{Lu}")).alias("n_capitals"),
        ),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_capitals",
          "n_stop_words", "n_lines", "n_bullet_lines", "n_cut_lines")


def passes(rule: Rule) -> Column:
    """The rule over the counts' columns; a share of nothing passes."""
    part, base = F.col(rule.part) * 100, F.col(rule.whole)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (part >= base * rule.low)
    if rule.high is not None:
        ok = ok & (part <= base * rule.high)
    return (base == 0) | ok


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The table with the counts, ``failed_rules`` (names, in the table's order), ``base_failed`` and ``kept``.

    Null and empty texts have no words, so they fail the base rule.  Repeated
    rows get the same verdict each; input columns named like a result are
    replaced by it; other columns stay.  An empty table stays empty.
    """
    groups = dict(zip(("words", "lines", "marks"), fresh(df, "words", "lines", "marks")))
    found = quality_counts(F.col(text))
    kept_columns = [c for c in df.columns if c not in {*COUNTS, "failed_rules", "base_failed", "kept"} or c == text]
    out = df.select(*[F.col(c) for c in kept_columns], *[found[k].alias(v) for k, v in groups.items()])
    fields = {
        "words": ("n_words", "word_chars", "n_stop_words", "n_repeat_words"),
        "lines": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines"),
        "marks": ("n_symbols", "n_exclaims", "n_capitals"),
    }
    counts = [F.col(f"{groups[g]}.{n}").cast("long").alias(n) for g, names in fields.items() for n in names]
    out = out.select(*[F.col(c) for c in kept_columns], *counts)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return out.withColumns({"failed_rules": failed, "base_failed": base}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules(table(spark, folder, "documents").select("doc_id", "text")).select(*RESULT)


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that every rule keeps."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "text")  # keeps clashing names apart
    # a plain filter would be pushed into the projection and repeat the counting for every rule that it names
    kept = F.explode(F.when(F.col("kept"), F.array(F.lit(True))))
    return quality_rules(row).select("row", kept.alias("kept_row")).select("row.*")


def _sql_rule(r: Rule) -> str:
    tests = []
    if r.low is not None:
        tests.append(f"{r.part} * 100 >= {r.whole} * {r.low}")
    if r.high is not None:
        tests.append(f"{r.part} * 100 <= {r.whole} * {r.high}")
    return f"({r.whole} = 0 or ({' and '.join(tests)}))"


def sql_counts(source: str) -> str:
    """Common table expressions ending in ``counted``: every column of ``source`` and the counts."""
    spelled = sorted(set(STOP_WORDS) | {w.capitalize() for w in STOP_WORDS} | {w.upper() for w in STOP_WORDS})
    stops = ", ".join(f"'{w}'" for w in spelled)
    space = "[\\x20\\x09-\\x0D]"
    return f"""
given as (select *, row_number() over () as _row, coalesce(text, '') as _t from {source}),
split as (
  select *, list_filter(regexp_split_to_array(_t, '{space}+'), lambda w: w <> '') as _w,
         list_filter(string_split(_t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as _l from given),
windows as (
  select _row, i, array_to_string(_w[i:i + {WINDOW - 1}], ' ') as win
  from (select _row, _w, unnest(range(1, len(_w) - {WINDOW - 2})) as i from split where len(_w) >= {WINDOW})),
twice as (select _row, i from windows qualify count(*) over (partition by _row, win) > 1),
covered as (
  select _row, sum(least({WINDOW}, i - before))::bigint as n
  from (select _row, i, coalesce(lag(i) over (partition by _row order by i), i - {WINDOW}) as before from twice) group by _row),
counted as (
  select split.*, len(_w)::bigint as n_words, length(array_to_string(_w, ''))::bigint as word_chars,
    len(regexp_extract_all(_t, '[#*$%&|<>]'))::bigint as n_symbols,
    len(regexp_extract_all(_t, '!'))::bigint as n_exclaims,
    len(regexp_extract_all(_t, '\\p{{Lu}}'))::bigint as n_capitals,
    len(list_filter(_w, lambda w: w in ({stops})))::bigint as n_stop_words,
    len(_l)::bigint as n_lines, (len(_l) - len(list_distinct(_l)))::bigint as n_dup_lines,
    len(list_filter(_l, lambda x: regexp_matches(x, '^{space}*[-*•]')))::bigint as n_bullet_lines,
    len(list_filter(_l, lambda x: regexp_matches(x, '(\\.\\.\\.|…){space}*$')))::bigint as n_cut_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words
  from split left join covered using (_row)),
judged as (
  select *, (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEATED}) as base_failed,
    {' and '.join(_sql_rule(r) for r in RULES)} as rules_kept
  from counted)"""


ORACLE = f"with {sql_counts('documents')} select {', '.join(RESULT[:-1])}, (not base_failed and rules_kept) as kept from judged"
