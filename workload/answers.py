"""Numbers, language, refusals, grounding and leakage in whole tables of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.constants import FRENCH_MARKERS, REFUSAL_MARKERS
from lamina.functions import numbers, text
from lamina.operators import grounding, leakage
from workload import tables as t
from workload.registry import query

_PATTERN = numbers.NUMBER_PATTERN.replace("'", "''")
_SEPARATORS = numbers.SEPARATORS


def _value(written: str) -> str:
    """A written number as a DOUBLE, in DuckDB."""
    bare = f"translate({written}, '{_SEPARATORS}', '')"
    comma, dot = f"position(',' IN {bare})", f"position('.' IN {bare})"
    return f"""TRY_CAST(CASE
        WHEN {comma} > 0 AND {dot} > {comma} THEN replace({bare}, ',', '')
        WHEN {comma} > 0 AND {dot} > 0 THEN replace(replace({bare}, '.', ''), ',', '.')
        WHEN {comma} > 0 AND length({bare}) - {comma} = 3 THEN replace({bare}, ',', '')
        ELSE replace({bare}, ',', '.') END AS DOUBLE)"""


def _numbers(key: str, column: str, relation: str) -> str:
    """(key, position, written, value) of every number of a text."""
    return (
        f"SELECT {key}, position, written, {_value('written')} AS value FROM (SELECT {key}, "
        f"unnest(found) AS written, generate_subscripts(found, 1) - 1 AS position FROM (SELECT {key}, "
        f"regexp_extract_all({column}, '{_PATTERN}') AS found FROM {relation}))"
    )


@query(
    "extract_numbers",
    f"SELECT doc_id, CAST(position AS INTEGER) AS position, written, value FROM "
    f"({_numbers('doc_id', 'text', 'documents')})",
)
def _(spark, sf):
    return grounding.extract_numbers(t.spread_table(spark, sf, "documents"), "doc_id", "text")


_FORMS = "[fr, replace(fr, chr(8239), ' '), en, replace(en, ',', ''), replace(replace(replace(en, ',', ';'), '.', ','), ';', '.')]"


@query(
    "normalise_number",
    f"SELECT o_orderkey, raw, {_value('raw')} AS value FROM (SELECT o_orderkey, unnest({_FORMS}) AS raw FROM "
    "(SELECT o_orderkey, en, replace(replace(replace(en, ',', ';'), '.', ','), ';', chr(8239)) AS fr FROM "
    "(SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS en FROM orders)))",
)
def _(spark, sf):
    # Every total in five ways of writing it.
    en = F.format_number("o_totalprice", 2)
    fr = numbers.fr_number(F.col("o_totalprice"), 2)
    german = F.translate(en, ",.", ".,")
    forms = F.array(fr, F.translate(fr, "\u202f", " "), en, F.translate(en, ",", ""), german)
    raw = t.table(spark, sf, "orders").select("o_orderkey", F.explode(forms).alias("raw"))
    return raw.withColumn("value", numbers.normalise_number(F.col("raw")))


@query(
    "fr_number",
    "SELECT o_orderkey, replace(replace(replace(format('{:,.1f}', o_totalprice), ',', ';'), '.', ','), "
    "';', chr(8239)) AS shown FROM orders",
)
def _(spark, sf):
    return t.table(spark, sf, "orders").select(
        "o_orderkey", numbers.fr_number(F.col("o_totalprice"), 1).alias("shown")
    )


_FR = "replace(replace(replace(format('{{:,.{0}f}}', {1}), ',', ';'), '.', ','), ';', chr(8239))"
_GROUND = f"""WITH answers AS (SELECT l_orderkey AS id, 'Le prix maximal est de ' ||
      {_FR.format(2, 'max(l_extendedprice)')} || ' pour ' || count(*) || ' lignes et ' ||
      {_FR.format(0, 'sum(l_quantity)')} || ' pièces.' AS answer FROM lineitem GROUP BY 1),
    evidence AS (SELECT l_orderkey AS id, 'quantity ' || CAST(l_quantity AS INTEGER) || ' price ' ||
      CAST(l_extendedprice AS DECIMAL(12,2)) AS evidence FROM lineitem),
    asked AS (SELECT * FROM ({_numbers('id', 'answer', 'answers')}) WHERE value NOT IN (0, 1, 2, 3, 4, 5, 100)
      AND NOT (value BETWEEN 1900 AND 2100 AND value = floor(value))),
    known AS (SELECT DISTINCT id, value AS e FROM ({_numbers('id', 'evidence', 'evidence')})),
    judged AS (SELECT id, position, written, value, coalesce(bool_or(abs(e - value) /
      greatest(abs(e), abs(value), 1e-9) <= 0.01 OR (round_even(e, 0) = round_even(value, 0) AND
      abs(e - value) < 1)), false) AS grounded FROM asked LEFT JOIN known USING (id) GROUP BY 1, 2, 3, 4),
    counted AS (SELECT a.id, count(written) AS numbers_checked, count(written) FILTER (WHERE grounded) AS
      numbers_grounded, coalesce(string_agg(written, '|' ORDER BY position) FILTER (WHERE NOT grounded), '')
      AS ungrounded FROM answers a LEFT JOIN judged j ON a.id = j.id GROUP BY 1) """


@query("grounding_check", _GROUND + "SELECT * FROM counted")
def _(spark, sf):
    checked = grounding.grounding_check(
        t.grounding_answers(spark, sf), t.grounding_evidence(spark, sf)
    )
    return checked.withColumn("ungrounded", F.array_join("ungrounded", "|"))


@query(
    "grounding_ratio",
    _GROUND + "SELECT id, round(CASE WHEN numbers_checked = 0 THEN 1.0 ELSE numbers_grounded / "
    "CAST(numbers_checked AS DOUBLE) END, 6) AS ratio, numbers_checked = numbers_grounded AS "
    "fully_grounded FROM counted",
)
def _(spark, sf):
    checked = grounding.grounding_check(
        t.grounding_answers(spark, sf), t.grounding_evidence(spark, sf)
    )
    n, found = F.col("numbers_checked"), F.col("numbers_grounded")
    ratio = grounding.grounding_ratio(n, found)
    return checked.select("id", F.round(ratio, 6).alias("ratio"), (n == found).alias("fully_grounded"))


def _any_of(column: str, phrases: tuple[str, ...]) -> str:
    tests = [f"contains({column}, '" + p.replace("'", "''") + "')" for p in phrases]
    return "(" + " OR ".join(tests) + ")"


@query(
    "detect_language",
    "SELECT doc_id, CASE WHEN " + _any_of("' ' || lower(text) || ' '", FRENCH_MARKERS) +
    " THEN 'fr' ELSE 'en' END AS language FROM documents",
)
def _(spark, sf):
    return t.spread_table(spark, sf, "documents").select(
        "doc_id", text.detect_language(F.col("text")).alias("language")
    )


@query(
    "is_refusal",
    "SELECT conv_id, turn, text, " + _any_of("lower(answer)", REFUSAL_MARKERS) + " AS refused FROM "
    "(SELECT *, CASE WHEN role = 'assistant' AND turn > 3 THEN 'Désolé, je ne peux pas répondre. ' || text "
    "WHEN role = 'assistant' AND turn = 3 THEN 'I''m sorry. ' || text ELSE text END AS answer "
    "FROM conversations)",
)
def _(spark, sf):
    # The given turns hold no refusals, so later assistant turns open with one.
    assistant = F.col("role") == "assistant"
    answer = (
        F.when(assistant & (F.col("turn") > 3), F.concat(F.lit("Désolé, je ne peux pas répondre. "), "text"))
        .when(assistant & (F.col("turn") == 3), F.concat(F.lit("I'm sorry. "), "text"))
        .otherwise(F.col("text"))
    )
    return t.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", text.is_refusal(answer).alias("refused")
    )


def _normal(column: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({column})), '[^a-z0-9 ]+', ' ', 'g'))"


@query("normalise_text", f"SELECT doc_id, {_normal('text')} AS normal FROM documents")
def _(spark, sf):
    return t.spread_table(spark, sf, "documents").select(
        "doc_id", text.normalise_text(F.col("text")).alias("normal")
    )


@query(
    "leakage_exact",
    f"SELECT doc_id, line FROM (SELECT doc_id, unnest(lines) AS line FROM (SELECT doc_id, "
    f"string_split(text, chr(10)) AS lines FROM documents)) WHERE {_normal('line')} IN (SELECT "
    f"{_normal('line')} FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))",
)
def _(spark, sf):
    def by_line(df, *keys):
        return df.select(*keys, F.explode(F.split("text", "\n")).alias("line"))

    questions = by_line(t.spread_table(spark, sf, "documents"), "doc_id")
    examples = by_line(t.table(spark, sf, "benchmark"))
    return leakage.leakage_exact(questions, examples, "line", "line")
