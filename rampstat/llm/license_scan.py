"""Licence scans: sentences to identifiers, identifier sequences to licences.

A text is joined over line ends, cut into sentences and normalised; a sentence
that a known pattern matches gets that pattern's identifier. The identifiers of
a text, in its order, are then matched against ordered rules: a rule's
identifiers must follow each other, and a rule takes what it matches.

All is column expressions on each text by itself, so nothing is shuffled. Texts
without any word stem of the known sentences, which cannot match, skip the rest.

Defined cases: a null or empty text has no sentences and the verdict ``none``; a
text that only names licences in sentences that no pattern knows is ``unknown``;
rows that repeat give equal rows; a null id stays null; texts are scanned whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.common import table, text_of
from rampstat.llm.license_rules import RULES, SENTENCES, STEMS

#: The most restrictive kind found is the verdict.
KINDS = ["restricted", "noncommercial", "noderivatives", "copyleft", "permissive"]

STEM = "|".join(STEMS).replace(" ", "[^a-z0-9]+")
#: Line ends with the comment marks of the next line; sentence ends.
SPACES = r"[\x09-\x0D\x20]*"
BLANK = rf"{SPACES}\n{SPACES}\n{SPACES}"
LINE = rf"{SPACES}\n[\x09-\x0D\x20*#/;%-]*"
END = r"[.!?;:][\x09-\x0D\x20]+"
#: No sentence ends after "v." before a number, nor in the GNU notices' "...; either version".
VERSION = r"(^|[^a-z0-9])(v|ver|vers)\.[\x09-\x0D\x20]+([0-9])"
EITHER = r";[\x09-\x0D\x20]+either[\x09-\x0D\x20]+version"


def normalised(text: Column) -> Column:
    """The sentences of a text, as an array."""
    s = F.regexp_replace(F.lower(text), BLANK, ". ")
    s = F.regexp_replace(F.regexp_replace(s, LINE, " "), VERSION, "$1v $3")
    s = F.split(F.regexp_replace(s, EITHER, ", either version"), END, -1)
    return F.transform(s, lambda x: F.replace(F.btrim(F.regexp_replace(x, "[^a-z0-9]+", F.lit(" "))), F.lit("licence"), F.lit("license")))


def sentence_id(s: Column) -> Column:
    """The identifier of a normalised sentence; ``Unknown`` if it only sounds like
    one of a licence, else null."""
    found = F.when(~F.rlike(s, F.lit(STEM.replace("[^a-z0-9]+", " "))), F.lit(None))
    for name, pattern in SENTENCES:
        found = found.when(F.rlike(s, F.lit(rf"\b(?:{pattern})\b")), F.lit(name))
    return found.when(F.rlike(s, F.lit(r"\blicensed? ")), F.lit("Unknown"))


def match_rules(ids: Column) -> Column:
    """The names that the ordered rules find in an array of identifiers."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f",{','.join(sequence)},").alias("run")) for name, _, sequence in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        # what a rule takes leaves a mark; twice, as neighbours share a comma
        left = F.replace(F.replace(state["left"], rule["run"], F.lit(",-,")), rule["run"], F.lit(",-,"))
        return F.struct(left.alias("left"), F.when(F.contains(state["left"], rule["run"]), F.array_append(state["found"], rule["name"]))
                        .otherwise(state["found"]).alias("found"))

    return F.aggregate(rules, start, step, lambda state: F.array_sort(F.array_distinct(state["found"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_sentences`` (known or unknown licence sentences),
    ``sentence_ids`` (in text order), ``licenses`` (sorted names) and ``verdict``."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col).cast("string")).alias("t"))
    likely = F.rlike(F.lower("t"), F.lit(STEM))
    ids = F.when(likely, F.filter(F.transform(normalised(F.col("t")), sentence_id), lambda x: x.isNotNull()))
    d = d.select("doc_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    found = F.when(F.size("ids") > 0, match_rules(F.col("ids"))).otherwise(F.array().cast("array<string>"))
    d = d.select("doc_id", "ids", found.alias("found"))
    kinds = {k: list(dict.fromkeys(n for n, kind, _ in RULES if kind == k)) for k in KINDS}
    verdict = reduce(lambda c, k: c.when(F.arrays_overlap("found", F.array(*map(F.lit, kinds[k]))), F.lit(k)), KINDS[1:],
                     F.when(F.arrays_overlap("found", F.array(*map(F.lit, kinds[KINDS[0]]))), F.lit(KINDS[0])))
    verdict = verdict.when(F.array_contains("ids", "Unknown"), F.lit("unknown")).otherwise(F.lit("none"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
                    F.array_join("found", ",").alias("licenses"), verdict.alias("verdict"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB's SQL, made from the same fixed values."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    arms = " ".join(rf"WHEN regexp_matches(s, {q(rf'\b(?:{p})\b')}) THEN {q(n)}" for n, p in SENTENCES)
    steps, found = [], []
    for k, (name, _, sequence) in enumerate(RULES):
        run = q(f",{','.join(sequence)},")
        found.append(f"CASE WHEN contains(l{k}, {run}) THEN {q(name)} END")
        steps.append(f"replace(replace(l{k}, {run}, ',-,'), {run}, ',-,') AS l{k + 1}")
    kinds = " ".join(f"WHEN list_has_any(found, [{', '.join(q(n) for n, kind, _ in RULES if kind == k)}]) THEN {q(k)}" for k in KINDS)
    return f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN regexp_matches(t, {q(STEM)}) THEN list_transform(string_split_regex(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {q(BLANK)}, '. ', 'g'), {q(LINE)}, ' ', 'g'),
          {q(VERSION)}, '\\1v \\3', 'g'), {q(EITHER)}, ', either version', 'g'), {q(END)}),
        lambda x: replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), 'licence', 'license')) ELSE [] END AS ss FROM d),
i AS (SELECT doc_id, list_filter(list_transform(ss, lambda s: CASE WHEN NOT regexp_matches(s, {q(STEM.replace("[^a-z0-9]+", " "))}) THEN NULL
        {arms} WHEN regexp_matches(s, '\\blicensed? ') THEN 'Unknown' END), lambda x: x IS NOT NULL) AS ids FROM s),
r AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS l0, {', '.join(steps)},
        list_sort(list_distinct(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))) AS found FROM i)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses,
       CASE {kinds} WHEN list_contains(ids, 'Unknown') THEN 'unknown' ELSE 'none' END AS verdict
FROM r
"""


ORACLE = oracle()
