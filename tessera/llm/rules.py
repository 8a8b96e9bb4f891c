"""Quality rules as a ledger of bits.

`ledger` evaluates every rule once for each text and stores the measurements and one 64-bit mask of failed rules.
Policies are versions of (mask, tolerated failures); applying one, or measuring what each rule contributes to it, reads
bits only, never texts. Everything is built-in expressions: one pass, no shuffle, no Python.

Measurements of a text t (a null text counts as empty): words are separated by runs of space, tab, newline, carriage
return or form feed; lines by newline.

A measurement that a text is too short for (a share of no words, say) is null, and a rule fails only on a value beyond its
bound, so texts without words fail `few_words` alone. Rows with null or repeated doc_id are all kept in the ledger.
Columns of other names than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SPACE = " \t\n\r\f"
SYMBOLS = "[^#$%&*!|@{}<>~^=+_\\\\/]+"


@dataclass(frozen=True)
class Rule:
    """Fails if the measurement is below `least` or above `most`; with `above_words` set only for texts of at least so many words.
    With `falls_from` set `least` falls beyond so many words, with the root of their number, as the share of distinct words of clean prose does."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    above_words: int = 0
    falls_from: int = 0


#: The position of a rule is its bit. Rules are only ever appended, so that stored masks stay valid.
RULES = (
    Rule("few_words", "n_words", least=1),
    Rule("many_words", "n_words", most=1_000_000),
    Rule("short_words", "mean_word", least=2.5),
    Rule("long_words", "mean_word", most=12),
    Rule("few_letters", "letter_share", least=0.6, above_words=20),
    Rule("upper_case", "upper_share", most=0.5),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("repeated_words", "distinct_share", most=None, least=0.3, above_words=20, falls_from=20_000),
    Rule("repeated_lines", "repeated_line_share", most=0.5),
    Rule("digits", "digit_share", most=0.6, above_words=20),
    Rule("bullets", "bullet_share", most=0.9, above_words=20),
    Rule("ellipses", "ellipsis_share", most=0.5, above_words=20),
    Rule("braces", "braces", most=4),
    Rule("placeholder", "placeholder", most=0),
)
MEASURES = ("n_words", "mean_word", "letter_share", "upper_share", "symbols_per_word", "distinct_share", "repeated_line_share", "digit_share", "bullet_share", "ellipsis_share", "braces", "placeholder")


def mask(*names: str) -> int:
    bits = {r.name: 1 << k for k, r in enumerate(RULES)}
    return sum(bits[n] for n in names)


@dataclass(frozen=True)
class Policy:
    """Keeps a text with at most `tolerated` failed rules of the mask."""

    mask: int
    tolerated: int = 0


POLICIES = {
    "v1": Policy(mask("few_words", "short_words", "long_words", "few_letters", "upper_case", "symbols", "repeated_words", "repeated_lines", "digits", "placeholder")),
    "v2": Policy((1 << len(RULES)) - 1),
    "v3": Policy((1 << len(RULES)) - 1, 1),
}


def _measures(text: Column) -> dict[str, Column]:
    """Over a column `_t` of non-null text and its words `_w` and lines `_l`; see ledger."""
    t, w, lines = F.col("_t"), F.col("_w"), F.col("_l")
    n, visible, letters = F.col("n_words"), F.col("_visible"), F.col("_letters")
    share = lambda part, whole: F.when(whole > 0, part.cast("double") / whole)
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return {
        "mean_word": share(visible, n),
        "letter_share": share(letters, visible),
        "upper_share": share(count("[^\\p{Lu}]+"), letters),
        "symbols_per_word": share(count(SYMBOLS), n),
        "distinct_share": share(F.size(F.array_distinct(w)), n),
        "repeated_line_share": F.lit(1.0) - F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "digit_share": share(count("[^0-9]+"), visible),
        "bullet_share": F.size(F.filter(lines, lambda x: x.rlike("^[ \\t]*[-*•]"))).cast("double") / F.size(lines),
        "ellipsis_share": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("double") / F.size(lines),
        "braces": count("[^{}]+").cast("long"),
        "placeholder": F.when(F.lower(t).contains("lorem ipsum"), 1).otherwise(0).cast("long"),
    }


def _bits() -> Column:
    total: Column | None = None
    for k, r in enumerate(RULES):
        bad = F.lit(False)
        if r.least is not None:
            falling = F.sqrt(F.lit(float(r.falls_from)) / F.greatest(F.col("n_words"), F.lit(r.falls_from)))
            bad = bad | (F.col(r.measure) < (F.lit(r.least) * falling if r.falls_from else r.least))
        if r.most is not None:
            bad = bad | (F.col(r.measure) > r.most)
        if r.above_words:
            bad = bad & (F.col("n_words") >= r.above_words)
        bit = F.when(bad, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        total = bit if total is None else total + bit
    return total


def measured(texts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of texts, then all measurements of its column `_t`, then `bits`."""
    base = texts.select(*keep, F.coalesce(F.col("_t").cast("string"), F.lit("")).alias("_t"))
    trimmed = F.btrim(F.col("_t"), F.lit(SPACE))
    base = base.select(*keep, "_t", F.when(F.length(trimmed) > 0, F.split(F.lower(trimmed), "[ \t\n\r\f]+")).otherwise(F.array().cast("array<string>")).alias("_w"), F.split("_t", "\n").alias("_l"))
    base = base.select(*keep, "_t", "_w", "_l", F.size("_w").cast("long").alias("n_words"), F.length(F.regexp_replace("_t", "[ \t\n\r\f]+", "")).alias("_visible"), F.length(F.regexp_replace("_t", "[^\\p{L}]+", "")).alias("_letters"))
    made = _measures(F.col("_t"))
    base = base.select(*keep, "n_words", *[made[m].alias(m) for m in MEASURES if m != "n_words"])
    return base.select(*keep, *MEASURES, _bits().alias("bits"))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, bits) for every row of docs."""
    return measured(docs.select("doc_id", F.col("text").alias("_t")), ["doc_id"])


def stored_ledger(docs: DataFrame) -> DataFrame:
    """ledger(docs), written once to the shared scratch folder: what policies and ablations read."""
    return written(ledger(docs), "ledger")


def kept_by(bits: Column, policy: Policy) -> Column:
    return F.bit_count(bits.bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.tolerated


def with_policies(rows: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """rows of a ledger with a column keep_<version> for each policy."""
    return rows.select("*", *[kept_by(F.col("bits"), p).alias(f"keep_{v}") for v, p in policies.items()])


def ablations(rows: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """For each policy and each rule of its mask (version, rule, failing, kept, kept_without): how many rows fail the rule,
    how many the policy keeps, and how many it would keep without the rule. An empty ledger has no rows.

    Only the distinct masks and their numbers are shuffled.
    """
    masks = rows.groupBy("bits").agg(F.count("*").alias("n"))
    cases = [(v, r.name, 1 << k, p.mask, p.tolerated) for v, p in policies.items() for k, r in enumerate(RULES) if p.mask >> k & 1]
    table = rows.sparkSession.createDataFrame(cases, "version string, rule string, bit long, mask long, tolerated int")
    bits = F.col("bits")
    kept = F.bit_count(bits.bitwiseAND(F.col("mask"))) <= F.col("tolerated")
    without = F.bit_count(bits.bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))) <= F.col("tolerated")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return masks.crossJoin(F.broadcast(table)).groupBy("version", "rule").agg(total(bits.bitwiseAND(F.col("bit")) != 0).alias("failing"), total(kept).alias("kept"), total(without).alias("kept_without"))


def passing(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """docs without the rows that the policy rejects; all columns stay as they are, whatever their names.

    The ledger is stored beside its rows, so that each text is measured once; the policy reads the stored bits.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]
    inside = docs.toDF(*names).withColumn("_t", F.col(names[docs.columns.index("text")]))
    stored = written(measured(inside, names), "ledger")
    return stored.where(kept_by(F.col("bits"), policy)).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def ledger_sql(table: str = "documents", policies: dict[str, Policy] = POLICIES) -> str:
    """with_policies(ledger(table)) in DuckDB's SQL."""
    rules = []
    for k, r in enumerate(RULES):
        falling = f" * sqrt({r.falls_from}.0::DOUBLE / greatest(n_words, {r.falls_from}))" if r.falls_from else ""
        bad = " OR ".join(x for x in (r.least is not None and f"{r.measure} < {r.least}{falling}", r.most is not None and f"{r.measure} > {r.most}") if x)
        rules.append(f"CASE WHEN ({bad}){f' AND n_words >= {r.above_words}' if r.above_words else ''} THEN {1 << k} ELSE 0 END")
    keeps = ", ".join(f"bit_count(bits & {p.mask}) <= {p.tolerated} AS keep_{v}" for v, p in policies.items())
    ws = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
    run = "'[ \\t\\n\\r\\f]+'"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"
    count = lambda p: f"length(regexp_replace(t, '{p}', '', 'g'))"
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
b AS (SELECT *, CASE WHEN length(trim(t, {ws})) > 0 THEN string_split_regex(lower(trim(t, {ws})), {run}) ELSE [] END AS w,
  string_split(t, chr(10)) AS l, length(regexp_replace(t, {run}, '', 'g')) AS visible, {count("[^\\p{L}]+")} AS letters FROM a),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words FROM b),
d AS (SELECT doc_id, n_words, {share("visible", "n_words")} AS mean_word, {share("letters", "visible")} AS letter_share,
  {share(count("[^\\p{Lu}]+"), "letters")} AS upper_share, {share(count(SYMBOLS), "n_words")} AS symbols_per_word,
  {share("len(list_distinct(w))", "n_words")} AS distinct_share,
  1.0::DOUBLE - CAST(len(list_distinct(l)) AS DOUBLE) / len(l) AS repeated_line_share, {share(count("[^0-9]+"), "visible")} AS digit_share,
  CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS DOUBLE) / len(l) AS bullet_share,
  CAST(len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS DOUBLE) / len(l) AS ellipsis_share,
  CAST({count("[^{}]+")} AS BIGINT) AS braces, CASE WHEN contains(lower(t), 'lorem ipsum') THEN 1 ELSE 0 END::BIGINT AS placeholder FROM c),
e AS (SELECT *, CAST({" + ".join(rules)} AS BIGINT) AS bits FROM d)
SELECT *, {keeps} FROM e"""


def ablations_sql(table: str = "documents", policies: dict[str, Policy] = POLICIES) -> str:
    """ablations(ledger(table)) in DuckDB's SQL."""
    cases = ", ".join(f"('{v}', '{r.name}', {1 << k}, {p.mask}, {p.tolerated})" for v, p in policies.items() for k, r in enumerate(RULES) if p.mask >> k & 1)
    total = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""
WITH ledger AS ({ledger_sql(table, policies)}), cases(version, rule, bit, mask, tolerated) AS (VALUES {cases})
SELECT version, rule, {total("(bits & bit) <> 0")} AS failing, {total("bit_count(bits & mask) <= tolerated")} AS kept,
  {total("bit_count(bits & (mask - bit)) <= tolerated")} AS kept_without
FROM ledger CROSS JOIN cases GROUP BY version, rule"""
