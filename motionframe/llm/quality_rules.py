"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over its bits.

``ledger`` makes one row per document with measurements and ``fail_bits``. Each rule owns one bit for good
(``BITS``), so bits stored by an earlier version keep their meaning; ``rules_version`` says which rules a
ledger knows. ``apply_policy`` turns a stored ledger and a versioned policy into a verdict without touching
texts again, and ``ablation`` counts, by one aggregation over the bits, what each rule adds to a policy.

Ties: a measure equal to its limit passes its rule. Texts of any length are measured whole.
Defined cases: a null text has no words, so it fails ``few_words``; every row of a repeated document
gets its own verdict, equal to the others'; null ids and other null columns stay as they are; an empty
table gives an empty ledger; further columns are ignored by ``ledger`` and kept by ``filter_documents``.
All of it is built from DataFrame functions: one pass, no shuffle, one row out for one row in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm._common import let, split_words, table, written

WINDOW = 8

#: The bit of each rule. Bits are never used again for another rule; a changed rule gets a new name and bit.
BITS = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "capitals": 3, "stutter": 4, "duplicate_lines": 5, "word_length": 6}
RULES_VERSION = 1


def _rules() -> dict[str, Column]:
    c, words, chars = F.col, F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "few_words": words < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * words,
        "symbols": 10 * c("n_symbols") > words,
        "capitals": 10 * c("n_upper") > 3 * chars,
        "stutter": 10 * c("n_stutter") > 3 * words,
        "duplicate_lines": (c("n_lines") > 1) & (10 * c("n_dup_lines") > 5 * c("n_lines")),
        "word_length": (c("word_chars") > 14 * words) | (c("word_chars") < 2 * words),
    }


@dataclass(frozen=True)
class Policy:
    """A named version of the verdict: a document is kept if none of ``rules`` failed."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
#: Length and repetition only; style is left to a learned model.
STRUCTURE = Policy("structure-1", ("few_words", "repeated_windows", "duplicate_lines", "word_length"))
DEFAULT = Policy("quality-1", ("few_words", "repeated_windows", "symbols", "capitals", "stutter", "duplicate_lines", "word_length"))
POLICIES = (BASE, STRUCTURE, DEFAULT)


def _repeat_words(hashes: Column) -> Column:
    """Words that stand in a window of eight words found at least twice in the text.

    The window hashes are compared by one pass of a hash set; positions are sorted only for texts that
    do repeat a window.
    """

    def covered(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda k: F.get(s, k)["h"].eqNullSafe(F.get(s, k + 1)["h"])
            hit = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k) | ((k > 0) & same(k - 1)), F.get(s, k)["i"]))
            return F.sort_array(F.array_compact(hit))

        def spans(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(tagged, twice), spans)

    def paired(h: Column, k: int) -> Column:
        return let(h, lambda v: F.zip_with(v, F.slice(v, k + 1, F.greatest(F.size(v) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y)))

    def windows(h: Column) -> Column:
        """Hashes of 2, then 4, then 8 words in a row; the last seven positions begin no window."""
        return let(paired(paired(paired(h, 1), 2), 4), lambda x: F.slice(x, 1, F.size(x) - (WINDOW - 1)))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0))

    return F.when(F.size(hashes) > WINDOW, let(windows(hashes), count)).otherwise(F.lit(0))


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__words", split_words(F.col(text_col)))
    df = df.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    shifted = F.slice("__hashes", 2, F.size("__hashes"))
    adjacent = F.size(F.array_remove(F.zip_with("__hashes", shifted, lambda a, b: F.coalesce(a == b, F.lit(False))), False))
    df = df.withColumn("__lines", lines)
    return df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": left("[^#*$%&|<>]+"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__hashes")).cast("long"),
        "n_upper": left(r"[^\p{Lu}]+"),
        "n_stutter": adjacent.cast("long"),
    }).drop("__words", "__hashes", "__lines")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stutter")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, ``fail_bits``) of every row of ``docs``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return _measured(own, "__text").withColumn("fail_bits", _bits()).select("doc_id", *MEASURES, "fail_bits", F.lit(RULES_VERSION).alias("rules_version"))


def _bits() -> Column:
    return sum((F.when(r, F.lit(1 << BITS[name])).otherwise(F.lit(0)) for name, r in _rules().items()), F.lit(0)).cast("long")


def fails(policy: Policy, bits: Column | None = None) -> Column:
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``policy`` and ``kept``."""
    return led.withColumns({"policy": F.lit(policy.name), "kept": ~fails(policy)})


def ablation(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of ``policy``: failures, failures by it alone (what dropping it would let in), and all rows.

    One aggregation over the stored bits; the texts aren't read.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = [F.count("*").alias("n")]
    for r in policy.rules:
        one = F.lit(1 << BITS[r]).cast("long")
        sums += [F.count_if(bits.bitwiseAND(one) != 0).alias(f"{r}__any"), F.count_if(bits == one).alias(f"{r}__only")]
    got = led.agg(*sums)
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"{r}__any").alias("failed"), F.col(f"{r}__only").alias("failed_alone"), F.col("n").alias("documents")) for r in policy.rules]
    return got.select(F.inline(F.array(*rows)))


def filter_documents(docs: DataFrame, policy: Policy = DEFAULT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only."""
    names = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    # The bits come out of a generator, which no predicate on them can pass: each text is measured once, then filtered by its bits.
    led = _measured(own, "__text").select("__row", F.explode(F.array(_bits())).alias("fail_bits"))
    return led.where(~fails(policy)).select("__row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ledger and verdict of every row of ``documents``."""
    led = apply_policy(written(ledger(table(spark, sf_dir, "documents")), "quality-ledger"), DEFAULT)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), "kept", "fail_bits", "policy")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and rejects alone, among all ``documents``; read from one stored ledger."""
    led = written(ledger(table(spark, sf_dir, "documents")).select("fail_bits"), "quality-ledger")
    return reduce(DataFrame.unionByName, (ablation(led, p).withColumn("policy", F.lit(p.name)) for p in POLICIES))


QUERIES = {"op9_quality_rules": op9_quality_rules, "quality_ablation": quality_ablation}

_LEDGER_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) > 7),
    win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM starts),
    twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS hit FROM win),
    place AS (SELECT r, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 7),
    cover AS (SELECT place.r, j, max(coalesce(hit, false)) OVER (PARTITION BY place.r ORDER BY j ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c
              FROM place LEFT JOIN twice ON place.r = twice.r AND j = i),
    rep AS (SELECT r, CAST(count(*) FILTER (WHERE c) AS BIGINT) AS n FROM cover GROUP BY r),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                 coalesce(rep.n, 0) AS n_repeat_words, CAST(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
                 CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_stutter
          FROM d LEFT JOIN rep ON rep.r = d.r),
    k AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
    led AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
                  + 8 * (10 * n_upper > 3 * greatest(word_chars, 1))::INT + 16 * (10 * n_stutter > 3 * n_words)::INT
                  + 32 * (n_lines > 1 AND 10 * n_dup_lines > 5 * n_lines)::INT + 64 * (word_chars > 14 * n_words OR word_chars < 2 * n_words)::INT AS BIGINT) AS fail_bits FROM k)"""

ORACLE = {
    "op9_quality_rules": _LEDGER_SQL + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'quality-1' AS policy FROM led""",
    "quality_ablation": _LEDGER_SQL + """,
        rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('capitals', 8), ('stutter', 16), ('duplicate_lines', 32), ('word_length', 64)),
        policies(policy, mask) AS (VALUES ('base-1', 3), ('structure-1', 99), ('quality-1', 127))
        SELECT policy, rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS failed, count(*) FILTER (WHERE fail_bits & mask = bit) AS failed_alone, count(*) AS documents
        FROM policies JOIN rules ON mask & bit <> 0 CROSS JOIN led GROUP BY policy, rule""",
}
