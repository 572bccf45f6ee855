"""Registered queries of the redaction floor over values that are planted beside the rows' own ids: SQL states what must be left."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirewarden.functions import redaction as R
from wirewarden.plans import adapters as A
from wirewarden.plans.queries import query

_T = lambda name: f"⟦REDACTED:{name}⟧"
#: What is planted (with the row's id where a value may vary), and what must be left of it.
PLANTED = (
    ("card {4111 1111 1111 1111} or {5555-5555-5555-4444}, not 4111 1111 1111 1112", "PAN"),
    ("mail {user$@example.com}, not user$@", "EMAIL"),
    ("account {DE89 3704 0044 0532 0130 00}, not DE88370400440532013000", "IBAN"),
    ("ssn {123-45-6789}, not 000-45-6789", "SSN"),
    ("call {+14155552671}, not 415 555 2671", "PHONE"),
    ("cvv: {123}, not cvv: 12345", "CVV"),
    ("key {sk_live_abcdef12$} and Bearer {abc.sk_live_abcdef123.zzzzzz}", "TOKEN"),
    ("run {amFuZS5kb2VAZXhhbXBsZS5jb20}, not YWJjZGVmZ2hpamtsbW5vcHFyc3R1dg", "EMAIL"),
    ("known ⟦REDACTED:SSN⟧ stays", None),
)


def _text(column: str, spark_sql: bool):
    """(planted, left) as expressions over an id column, in Spark or DuckDB."""
    import re

    planted = " ; ".join(re.sub(r"[{}]", "", t) for t, _ in PLANTED)
    left = " ; ".join(re.sub(r"\{[^}]*\}", _T(name) if name else "", t) for t, name in PLANTED)
    parts = lambda s: [x for x in re.split(r"(\$)", s) if x]
    if spark_sql:
        return [F.concat(*[F.col(column).cast("string") if x == "$" else F.lit(x) for x in parts(s)]) for s in (planted, left)]
    return [" || ".join(f"CAST({column} AS VARCHAR)" if x == "$" else f"'{x}'" for x in parts(s)) for s in (planted, left)]


_IDS = ["PAN", "EMAIL", "IBAN", "SSN", "PHONE", "CVV", "TOKEN"]
_PATTERNS = "[" + ", ".join(f"'{x}'" for x in _IDS) + "]"


@query("red_planted_text", f"SELECT doc_id, {_text('doc_id', False)[1]} AS planted, {_PATTERNS} AS patterns, true AS has_token, CASE WHEN doc_id % 2 = 0 THEN 'SSN' END AS whole FROM documents")
def red_planted_text(spark, sf):
    """RED1 to RED9, RED11, RED12, RED20: a line of values beside each document's id."""
    d = A.table(spark, sf, "documents").select("doc_id", _text("doc_id", True)[0].alias("planted"))
    out = R.redact(d, "planted")
    whole = R.redact(d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "123-45-6789").otherwise("ssn 123-45-6789").alias("w")), "w", patterns="_p").select("doc_id", R.whole_token_id(F.col("w")).alias("whole"))
    return out.withColumn("has_token", R.contains_token(F.col("planted"))).join(whole, "doc_id")


@query("red_planted_census", "SELECT source, unnest(['CVV', 'EMAIL', 'IBAN', 'PAN', 'PHONE', 'SSN', 'TOKEN']) AS pattern, count(*) AS n_rows FROM documents GROUP BY source")
def red_planted_census(spark, sf):
    """RED19: rows by the pattern that fired and source."""
    d = A.table(spark, sf, "documents").select("source", _text("doc_id", True)[0].alias("planted"))
    return R.census(R.redact(d, "planted"), "source")


_OPEN = "{"


@query("red_planted_json", f"""SELECT doc_id, '{{"pan":4111111111111111,"plus":"{_T('PHONE')}","cvv":"{_T('CVV')}","n":123,"deep":{{"a/b":["{_T('EMAIL')}",' || doc_id || ']}}}}' AS body, '/deep/a~1b/0' AS path, 'EMAIL' AS pattern, length('u' || doc_id || '@x.example') AS length, ['PAN', 'EMAIL', 'PHONE', 'CVV'] AS patterns
 FROM documents""".replace('"pan":4111111111111111', f'"pan":"{_T("PAN")}"'))
def red_planted_json(spark, sf):
    """RED1, RED8, RED13, RED14: numbers and strings of JSON in place, escapes decoded, the replaced values' properties."""
    body = F.concat(F.lit('{"pan":4111111111111111,"plus":"\\u002B14155552671","cvv":987,"n":123,"deep":{"a/b":["u'), F.col("doc_id").cast("string"), F.lit('@x.example",'), F.col("doc_id").cast("string"), F.lit("]}}"))
    d = A.table(spark, sf, "documents").select("doc_id", body.alias("before")).withColumn("body", F.col("before"))
    out = R.redact(d, "body").withColumn("f", F.get(F.filter(R.redacted_fields("before", "body"), lambda f: f["pattern"] == "EMAIL"), 0))
    return out.select("doc_id", "body", F.col("f.path").alias("path"), F.col("f.pattern").alias("pattern"), F.col("f.length").cast("long").alias("length"), "patterns")


@query("red_planted_form", f"SELECT doc_id, 'a=' || doc_id || '&card_cvv={_T('CVV')}&mail={_T('EMAIL')}' AS form, ['EMAIL', 'CVV'] AS patterns FROM documents")
def red_planted_form(spark, sf):
    """RED1, RED8: form bodies pair by pair."""
    form = F.concat(F.lit("a="), F.col("doc_id").cast("string"), F.lit("&card_cvv=123&mail=u"), F.col("doc_id").cast("string"), F.lit("@x.example"))
    return R.redact(A.table(spark, sf, "documents").select("doc_id", form.alias("form")), "form")


@query("red_planted_address", f"SELECT page_id, 'from {_T('IP')} to {_T('IP')}, not 999.1.1.1' AS line, ['IP'] AS patterns, 'from 10.1.2.' || (page_id % 250) || ' to ::1, not 999.1.1.1' AS unasked FROM pages")
def red_planted_address(spark, sf):
    """RED10: addresses, only where they are asked for."""
    line = F.concat(F.lit("from 10.1.2."), (F.col("page_id") % 250).cast("string"), F.lit(" to ::1, not 999.1.1.1"))
    d = A.table(spark, sf, "pages").select("page_id", line.alias("line"), line.alias("unasked"))
    return R.redact(R.redact(d, "line", ip=True), "unasked", patterns="_none").drop("_none")


@query("red_own_recognizer", "SELECT doc_id, 'ticket ⟦REDACTED:TICKET⟧' AS line FROM documents")
def red_own_recognizer(spark, sf):
    """UDF1: a set of recognisers of the caller's own."""
    import re

    own = R.Recognizer("TICKET", re.compile(r"T-[0-9]+"))
    d = A.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("ticket T-"), F.col("doc_id").cast("string")).alias("line"))
    return R.redact(d, "line", recognizers=(own,)).select("doc_id", "line")


@query("red_call_records", f"""SELECT id, '{{"mail":"{_T('EMAIL')}"}}' AS request, 'ok' AS response, ['EMAIL', 'IBAN'] AS patterns, CASE WHEN id % 2 = 0 THEN ['request:/mail:KNOWN'] ELSE ['response:/x:IBAN', 'request:/mail:EMAIL'] END AS fields FROM calls""", A.CALLS)
def red_call_records(spark, sf):
    """RED17, SET3: patterns and field records are added, those that a record has win."""
    field = lambda part, path, name: F.array(F.struct(F.lit(part).alias("part"), F.lit(path).alias("path"), F.lit(name).alias("pattern")))
    c = A.calls(spark, sf).select("id", F.concat(F.lit('{"mail":"u'), F.col("id").cast("string"), F.lit('@x.example"}')).alias("request"), F.lit("ok").alias("response"), F.array(F.lit("IBAN")).alias("patterns"),
                                  F.when(F.col("id") % 2 == 0, field("request", "/mail", "KNOWN")).otherwise(field("response", "/x", "IBAN")).alias("fields"))
    out = R.redact_call_records(c, {"request": "request", "response": "response"})
    return out.withColumn("fields", F.transform("fields", lambda f: F.concat_ws(":", f["part"], f["path"], f["pattern"])))


@query("red_snapshots", f"""SELECT id, '{{"tools":[{{"name":"t","description":"ask {_T('EMAIL')}"}}]}}' AS snapshot_json, CASE WHEN id % 2 = 0 THEN '["run","--key","{_T('TOKEN')}"]' ELSE 'run {_T('EMAIL')}' END AS server_command FROM calls""", A.CALLS)
def red_snapshots(spark, sf):
    """RED18: listings, and the command element by element."""
    c = A.calls(spark, sf).select("id", F.concat(F.lit('{"tools":[{"name":"t","description":"ask u'), F.col("id").cast("string"), F.lit('@x.example"}]}')).alias("snapshot_json"),
                                  F.when(F.col("id") % 2 == 0, '["run","--key","sk_live_abcdef12"]').otherwise("run a@x.example").alias("server_command"))
    return R.redact_snapshots(c)


@query("red_nested", f"SELECT doc_id, ['mail={_T('EMAIL')}', 'n=' || doc_id] AS entries, '{_T('SSN')}' AS inner_value FROM documents")
def red_nested(spark, sf):
    """RED15: map and struct columns."""
    d = A.table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("mail"), F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("@x.example")), F.lit("n"), F.col("doc_id").cast("string")).alias("m"),
                                               F.struct(F.lit("123-45-6789").alias("ssn"), F.col("doc_id").alias("k")).alias("s"))
    out = R.redact_nested(R.redact_nested(d, "m"), "s")
    return out.select("doc_id", F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("entries"), F.col("s.ssn").alias("inner_value"))


@query("red_enhanced", f"""SELECT doc_id, '{{"a":{{"b":[{{"c":"{_T('ACCOUNT')}"}},{{"c":"{_T('PAN')}"}}]}},"n":' || doc_id || '}}' AS body FROM documents""")
def red_enhanced(spark, sf):
    """RED16, UDF3: leaves at given paths, one of them a token before."""
    body = F.concat(F.lit('{"a":{"b":[{"c":"x'), F.col("doc_id").cast("string"), F.lit('"},{"c":"⟦REDACTED:PAN⟧"}]},"n":'), F.col("doc_id").cast("string"), F.lit("}"))
    return R.enhance(A.table(spark, sf, "documents").select("doc_id", body.alias("body")), "body", [("a.b[].c", "ACCOUNT")])


@query("prj_redacted_findings", f"SELECT id, 'type=string' AS expected, 'value {_T('EMAIL')}' AS actual, CASE WHEN id % 2 = 0 THEN '{_T('SSN')}' END AS detail FROM findings", A.CALLS, A.FINDINGS)
def prj_redacted_findings(spark, sf):
    """PRJ4: what findings say, redacted on the way out."""
    f = A.findings(spark, sf).select("id", F.lit("type=string").alias("expected"), F.concat(F.lit("value u"), F.col("id").cast("string"), F.lit("@x.example")).alias("actual"), F.when(F.col("id") % 2 == 0, "123-45-6789").alias("detail"))
    return R.redact_findings(f)
