"""Quality rules with host-level verdicts.

Each document is measured and held against document rules. Rule failures are added up by host (the
``source`` column stands for the domain), and each host's failure rate is shrunk towards the corpus by a
beta prior whose mean and strength are estimated from the hosts themselves, so a host with few documents
is judged mostly by the corpus. The host verdicts are joined back: a document that fails a soft rule goes
only if its host fails that rule habitually, and a host that fails nearly always loses all its documents.

Repeated three-word windows are found inside one row without Python: 36 hash bits and 28 position bits
share a long, a primitive sort brings equal windows together, and only windows whose bits meet are then
compared as text, so the counts are exact.

Cases: a null, empty or blank text has no words, fails the base rule and counts for its host; a null host
is a host of its own; equal rows are judged alike; an empty table gives no row. Columns of the input that
clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspan.llm.tables import table, written

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SOFT = ["symbols", "dup_lines", "word_length"]
PLACE_BITS = 28


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_words`` (array) and the measures of ``text``, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lit((1 << PLACE_BITS) - 1)
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    head = lambda x: F.shiftright(x, PLACE_BITS)
    return (
        docs.drop(*MEASURES, "n_lines")
        .withColumn("_words", F.array_remove(F.split(body, SPACE, -1), ""))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_packed", F.sort_array(F.transform(
            F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda w, i: F.shiftleft(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)), PLACE_BITS)
            .bitwiseOR(i.cast("long")))))
        # Windows whose hash bits occur more than once.
        .withColumn("_met", F.filter("_packed", lambda x, i: (
            (F.coalesce(head(F.get("_packed", i + 1)) == head(x), F.lit(False)))
            | (F.coalesce((i > 0) & (head(F.get("_packed", i - 1)) == head(x)), F.lit(False))))))
        .withColumn("_keys", F.array_sort(F.transform("_met", lambda x: F.struct(
            F.concat_ws(" ", *[F.get("_words", x.bitwiseAND(low).cast("int") + j) for j in range(3)]).alias("key"),
            x.bitwiseAND(low).alias("at")))))
        .withColumn("_at", F.sort_array(F.transform(
            F.filter("_keys", lambda x, i: (
                F.coalesce(F.get("_keys", i + 1)["key"] == x["key"], F.lit(False))
                | F.coalesce((i > 0) & (F.get("_keys", i - 1)["key"] == x["key"]), F.lit(False)))),
            lambda x: x["at"])))
        # Every repeated window covers up to the next one, three words at most.
        .withColumn("n_repeat_words", F.aggregate(
            F.transform("_at", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", i + 1) - x, F.lit(3).cast("long")))),
            F.lit(0).cast("long"), lambda total, x: total + x))
        .drop("_lines", "_packed", "_met", "_keys", "_at")
    )


def base_rule() -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_rules() -> dict[str, Column]:
    """Soft rules by name: true where a document fails."""
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }


def host_rates(flags: DataFrame, rules: list[str], keys: list[str]) -> DataFrame:
    """Shrunk failure rate of each host and rule, as ``rate_<rule>``.

    The prior of a rule has the corpus rate as mean m. Its strength is m (1 - m) / v - 1 documents, where v
    is the variance between the hosts' rates (weighted by documents) less what chance alone gives; it is
    held between 1 and ``10 ** 6``. The counts are written first: their measured size decides whether they
    are broadcast, and where they are not, adaptive execution can split the partition of a large host.
    """
    hosts = written(flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(r).cast("long")).alias(f"_k_{r}") for r in rules]), "hosts")
    total = hosts.agg(
        F.sum("_n").alias("docs"), F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"_k_{r}").alias(f"k_{r}") for r in rules],
        *[F.sum(F.col(f"_k_{r}") * F.col(f"_k_{r}") / F.col("_n")).alias(f"q_{r}") for r in rules],
    ).first()
    rates = []
    for r in rules:
        docs = total["docs"] or 1
        mean = (total[f"k_{r}"] or 0) / docs
        chance = mean * (1 - mean)
        between = (total[f"q_{r}"] or 0) / docs - mean * mean - chance * total["hosts"] / docs
        strength = max(1.0, min(1e6, chance / between - 1)) if between > 0 else 1e6
        rates.append(((F.col(f"_k_{r}") + F.lit(mean * strength)) / (F.col("_n") + F.lit(strength))).alias(f"rate_{r}"))
    return hosts.select(*keys, *rates)


def _flagged(docs: DataFrame, host: str) -> DataFrame:
    """``docs`` with the measures, the rules' outcomes and the host as a key that is never null."""
    rules = soft_rules()
    # The measures are generated, not projected: else the optimizer would copy them into every later filter.
    return (
        measured(docs)
        .select(*[F.col(c) for c in docs.columns if c not in [*MEASURES, "n_lines"]],
                F.inline(F.array(F.struct(*MEASURES, "n_lines"))))
        .withColumn("base_failed", base_rule())
        .withColumns({f"_f_{name}": rule for name, rule in rules.items()})
        .withColumn("_f_any", F.col("base_failed") | F.greatest(*[F.col(f"_f_{r}").cast("int") for r in rules]).cast("boolean"))
        .withColumn("_null", F.col(host).isNull())
        .withColumn("_host", F.coalesce(F.col(host), F.lit("")))
        .drop("n_lines")
    )


def _verdicts(flagged: DataFrame, hosts: DataFrame, habit: float, hopeless: float) -> DataFrame:
    caught = F.lit(False)
    for r in SOFT:
        caught = caught | (F.col(f"_f_{r}") & (F.col(f"rate__f_{r}") >= habit))
    return (
        flagged.join(hosts, ["_null", "_host"])
        .withColumn("host_rejected", F.col("rate__f_any") >= hopeless)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~caught)
    )


def _hosts(flagged: DataFrame) -> DataFrame:
    return host_rates(flagged, [*[f"_f_{r}" for r in SOFT], "_f_any"], ["_null", "_host"])


def quality_verdicts(docs: DataFrame, host: str = "source", id_column: str = "doc_id",
                     habit: float = 0.05, hopeless: float = 0.9) -> DataFrame:
    """One row per document: id, measures, ``base_failed``, ``host_rejected`` and ``kept``.

    ``habit`` is the shrunk rate of a soft rule from which on a host's failures count as habit; a host
    whose shrunk rate of failing any rule reaches ``hopeless`` is rejected as a whole.
    """
    slim = written(_flagged(docs.select(id_column, host, "text"), host).drop("text", host), "quality")
    return _verdicts(slim, _hosts(slim), habit, hopeless).select(id_column, *MEASURES, "base_failed", "host_rejected", "kept")


def kept_documents(docs: DataFrame, host: str = "source", habit: float = 0.05, hopeless: float = 0.9) -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are measured twice instead of being shuffled to their verdicts."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(host).alias("source"), "text")
    slim = written(_flagged(rows.drop("_row"), "source").drop("text", "source", *MEASURES), "quality")
    return _verdicts(_flagged(rows, "source"), _hosts(slim), habit, hopeless).filter("kept").select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_verdicts(docs)


_RATE = """
  ({k} + m_{r} * s_{r}) / (n + s_{r}) AS rate_{r}"""
_STRENGTH = """
  CASE WHEN v_{r} > 0 THEN greatest(1.0, least(1e6, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1e6 END AS s_{r}"""
_ALL = ["symbols", "dup_lines", "word_length", "anyrule"]

OP2_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS id, doc_id, source IS NULL AS sn, coalesce(source, '') AS s, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
windows AS (
  SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM base, unnest(range(1, len(words) - 1)) AS t(i)),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT id, count(DISTINCT i + d)::BIGINT AS n_repeat_words FROM again, unnest([0, 1, 2]) AS t(d) GROUP BY id),
measures AS (
  SELECT id, doc_id, sn, s, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base LEFT JOIN repeated USING (id)),
flags AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words AS f_symbols, 10 * n_dup_lines > 3 * n_lines AS f_dup_lines,
         word_chars < 3 * n_words OR word_chars > 12 * n_words AS f_word_length
  FROM measures),
flagged AS (SELECT *, base_failed OR f_symbols OR f_dup_lines OR f_word_length AS f_anyrule FROM flags),
hosts AS (SELECT sn, s, count(*) AS n, {", ".join(f"sum(f_{r}::INT)::DOUBLE AS k_{r}" for r in _ALL)} FROM flagged GROUP BY sn, s),
totals AS (SELECT sum(n) AS docs, count(*) AS hosts,
  {", ".join(f"sum(k_{r}) / sum(n) AS m_{r}, sum(k_{r} * k_{r} / n) AS q_{r}" for r in _ALL)} FROM hosts),
spread AS (SELECT *, {", ".join(f"q_{r} / docs - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * hosts / docs AS v_{r}" for r in _ALL)}
  FROM totals),
prior AS (SELECT *, {",".join(_STRENGTH.format(r=r) for r in _ALL)} FROM spread),
rates AS (SELECT sn, s, {",".join(_RATE.format(r=r, k="k_" + r) for r in _ALL)} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       rate_anyrule >= 0.9 AS host_rejected,
       NOT base_failed AND NOT rate_anyrule >= 0.9
       AND NOT ({" OR ".join(f"(f_{r} AND rate_{r} >= 0.05)" for r in _ALL[:3])}) AS kept
FROM flagged JOIN rates USING (sn, s)
"""
