"""Registered queries over folders of files, request bodies and streams, each with its SQL.

The driver's tables hold no files, so a folder is written from the keys of a
table first: seven kinds of files for each nation.
"""

# ruff: noqa: E501

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..operators import bodies, guard, tokens
from ..operators import detect as D
from ..session import shared_dir, stored
from ..sources import formats, side
from ..streaming import events
from . import batch
from .carriers import carrier
from .queries import CONTACT, SECRET, TENANT, _anonymized, _round_trip, _table
from .queries_sql import _MAIL, _PHONE, _T_MAIL, _T_PHONE, _token

QUERIES, SQL = {}, {}


def row(sql: str):
    def add(query):
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return add


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def _file(kind: str, key: int) -> bytes:
    mail, phone = f"c{key}@x.ae", f"05{key:08}"
    if kind == "docx":
        return _zip({"word/document.xml": f'<w:p><w:t xml:space="preserve">mail {mail} &amp; co</w:t><w:t/><w:t></w:t><w:t>tel {phone}</w:t></w:p>'})
    if kind == "xlsx":
        return _zip({"xl/worksheets/sheet1.xml": f"<c><is><t>tel {phone}</t></is></c>", "xl/sharedStrings.xml": f"<si><t>{mail}</t></si>"})
    texts = {
        "txt": f"mail {mail} now", "md": f"# {mail}", "csv": f'name,phone,note\n"A, {key}",{phone},\nx,,see {mail}\n', "html": f'<!DOCTYPE html><p title="a>b">Call {phone}</p><script>var a="<{mail}>";</script><!-- {mail} --><b>&amp; ok</b>',
        "json": json.dumps({"list": {"iban": [f"x{key}", "EMAIL_18686338BC2AD87A"]}, "customer_name": f"C{key}", "note": f"mail {mail}", "n": key, "a/b": {"amount": phone}}), "": ' \n {"k": "bare %d"}' % key,
    }
    return texts[kind].encode()


@pandas_udf(T.BinaryType())
def _bytes(kind: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([_file(k, int(n)) for k, n in zip(kind, key, strict=True)])


_KINDS = ["txt", "md", "csv", "json", "html", "docx", "xlsx", ""]


def _folder(spark, sf_dir) -> str:
    """The path of a folder with files <nation>.<extension>, and files without one."""
    files = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.explode(F.array(*map(F.lit, _KINDS))).alias("ext"))
    files = files.select(F.concat("key", F.when(F.col("ext") == "", "").otherwise(F.concat(F.lit("."), "ext"))).alias("output"), _bytes("ext", "key").alias("content"))
    folder = shared_dir(spark, "folder").removeprefix("file:")
    batch.write_files(files, folder)
    return folder


def _name():
    return F.regexp_extract("path", r"([^/]+)$", 1)


_LISTED = "SELECT n_nationkey AS k, e, n_nationkey || CASE WHEN e = '' THEN '' ELSE '.' || e END AS name FROM nation, unnest(['txt', 'md', 'csv', 'json', 'html', 'docx', 'xlsx', '']) t(e)"


@row(f"SELECT name, CASE WHEN e = '' THEN 'JSON' ELSE upper(e) END AS kind FROM ({_LISTED})")
def folder_kinds(spark, sf_dir):
    """A folder's files and their kinds: by extension, else by bytes."""
    return formats.read_documents(spark, _folder(spark, sf_dir)).select(_name().alias("name"), "kind")


_PIECES = {
    "txt": [("whole", "'mail c' || k || '@x.ae now'")], "md": [("whole", "'# c' || k || '@x.ae'")], "": [("/k", "'bare ' || k")],
    "csv": [("0,0", "'name'"), ("0,1", "'phone'"), ("0,2", "'note'"), ("1,0", "'A, ' || k"), ("1,1", "'05' || lpad(k::VARCHAR, 8, '0')"), ("1,2", "''"), ("2,0", "'x'"), ("2,1", "''"), ("2,2", "'see c' || k || '@x.ae'")],
    "json": [("/a~1b/amount", "'05' || lpad(k::VARCHAR, 8, '0')"), ("/customer_name", "'C' || k"), ("/list/iban/0", "'x' || k"), ("/list/iban/1", "'EMAIL_18686338BC2AD87A'"), ("/note", "'mail c' || k || '@x.ae'")],
    "html": [("node 0", "'Call 05' || lpad(k::VARCHAR, 8, '0')"), ("node 1", "'&amp; ok'")],
    "docx": [("word/document.xml 0", "'mail c' || k || '@x.ae & co'"), ("word/document.xml 2", "'tel 05' || lpad(k::VARCHAR, 8, '0')")],
    "xlsx": [("xl/sharedStrings.xml 0", "'c' || k || '@x.ae'"), ("xl/worksheets/sheet1.xml 0", "'tel 05' || lpad(k::VARCHAR, 8, '0')")],
}


def _pieces_sql(change=lambda kind, where, text: text) -> str:
    return "\nUNION ALL ".join(f"SELECT name, '{where}' AS locator, {change(kind, where, text)} AS text FROM ({_LISTED}) WHERE e = '{kind}'" for kind, pieces in _PIECES.items() for where, text in pieces)


def _pieces(files, column="content"):
    read = files.withColumn("x", formats.extracting()(F.col(column), F.col("kind")))
    parts = read.select("path", F.explode("x.segments").alias("s"), F.col("x.text").alias("t"))
    return parts.select(_name().alias("name"), "s.locator", F.substr("t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


@row(_pieces_sql())
def folder_segments(spark, sf_dir):
    """Every piece of text of every file, and where it stands."""
    return _pieces(formats.read_documents(spark, _folder(spark, sf_dir)))


_MAILED, _CALLED = _token("EMAIL", "'c' || k || '@x.ae'"), _token("PHONE", "'05' || lpad(k::VARCHAR, 8, '0')")


def _redacted(kind: str, where: str, text: str) -> str:
    if kind == "csv":
        whole = {"1,0": _token("PERSON", "'a, ' || k"), "1,1": _CALLED, "2,0": _token("PERSON", "'x'")}
        return whole.get(where, text if where != "2,2" else f"'see ' || {_MAILED}")
    told = {"/customer_name": _token("PERSON", "'c' || k"), "/list/iban/0": _token("IBAN", "'X' || k")}
    if where in told:
        return told[where]
    return f"replace(replace({text}, 'c' || k || '@x.ae', {_MAILED}), '05' || lpad(k::VARCHAR, 8, '0'), {_CALLED})"


def _done(spark, sf_dir):
    files = formats.read_documents(spark, _folder(spark, sf_dir))
    return stored(batch.redact_documents(files, SECRET, TENANT, which=CONTACT, tables=True), "redacted")


@row(_pieces_sql(_redacted))
def folder_redacted(spark, sf_dir):
    """The pieces of the redacted files: JSON by its keys, CSV by its headers, the others as texts."""
    return _pieces(_done(spark, sf_dir), "redacted")


@row(_pieces_sql())
def folder_restored(spark, sf_dir):
    """Redacted files restored in their own formats hold the texts that they held."""
    done = _done(spark, sf_dir)
    known = spark.createDataFrame([("EMAIL_18686338BC2AD87A", "EMAIL_18686338BC2AD87A")], "token string, value string")
    vault = tokens.vault(done, "path").select("token", "value").unionByName(known)
    back = batch.restore_documents(done.select("path", F.col("redacted").alias("content"), "kind"), stored(vault, "vault"))
    return _pieces(back, "restored")


@row(f"SELECT DISTINCT kind, token FROM (SELECT 'EMAIL' AS kind, {_MAILED} AS token FROM (SELECT n_nationkey AS k FROM nation) UNION ALL SELECT 'PHONE', {_CALLED} FROM (SELECT n_nationkey AS k FROM nation) UNION ALL SELECT 'PERSON', {_token('PERSON', chr(39) + 'a, ' + chr(39) + ' || k')} FROM (SELECT n_nationkey AS k FROM nation) UNION ALL SELECT 'PERSON', {_token('PERSON', chr(39) + 'c' + chr(39) + ' || k')} FROM (SELECT n_nationkey AS k FROM nation) UNION ALL SELECT 'PERSON', {_token('PERSON', chr(39) + 'x' + chr(39))} UNION ALL SELECT 'IBAN', {_token('IBAN', chr(39) + 'X' + chr(39) + ' || k')} FROM (SELECT n_nationkey AS k FROM nation))")
def folder_vault(spark, sf_dir):
    """The merged vault of a redacted folder."""
    return tokens.vault(_done(spark, sf_dir), "path").select("kind", "token")


@row(f"SELECT name, CASE WHEN e = '' THEN 'json' ELSE e END AS extension, CASE e WHEN '' THEN 0 WHEN 'json' THEN 4 WHEN 'csv' THEN 4 WHEN 'docx' THEN 2 WHEN 'xlsx' THEN 2 ELSE 1 END AS total, true AS same_size FROM ({_LISTED})")
def folder_manifest(spark, sf_dir):
    """A folder redacted to files named by the hash of their path; the manifest's sizes are the files'."""
    source, out = _folder(spark, sf_dir), shared_dir(spark, "out").removeprefix("file:")
    manifest, _ = batch.redact_folder(spark, source, out, SECRET, TENANT, which=CONTACT, tables=True)
    names = spark.read.format("binaryFile").load(source).select(F.sha2("path", 256).alias("path_hash"), _name().alias("name"))
    sizes = spark.read.format("binaryFile").load(out).select(_name().alias("output"), F.col("length").cast("int").alias("length"))
    joined = manifest.join(names, "path_hash").join(sizes, "output")
    return joined.select("name", F.substring_index("output", ".", -1).alias("extension"), "total", (F.col("size") == F.col("length")).alias("same_size"))


@row(f"SELECT name, CASE e WHEN 'csv' THEN 2 WHEN 'json' THEN 2 WHEN 'html' THEN 3 WHEN '' THEN 0 WHEN 'docx' THEN 0 WHEN 'xlsx' THEN 0 ELSE 1 END AS total FROM ({_LISTED}) WHERE e NOT IN ('docx', 'xlsx')")
def folder_scan(spark, sf_dir):
    """Detections by file of a folder's files read as plain text."""
    folder = _folder(spark, sf_dir)
    summaries, _ = batch.scan_folder(spark, folder, ["txt", "md", "csv", "json", "html", ""], which=CONTACT)
    names = spark.read.format("binaryFile").load(folder).select(F.sha2("path", 256).alias("path_hash"), _name().alias("name"))
    return summaries.join(names, "path_hash").select("name", F.col("total").cast("int").alias("total"))


@row("SELECT page_id, 'text of ' || page_id AS body, 'a' || page_id || '|b' AS custom FROM pages")
def adapter_registry(spark, sf_dir):
    """A PDF is put back as plain text; a caller's own kind of document is read and put back by its adapter."""
    adapters = formats.ADAPTERS | {"BARS": formats.Adapter(lambda b: (b.decode().replace("|", "\x1e"), []), lambda b, t: t.replace("\x1e", "|").encode())}
    pages = _table(spark, sf_dir, "pages").select("page_id", F.encode(F.concat(F.lit("a"), "page_id", F.lit("|b")), "UTF-8").alias("content"))
    read = stored(pages.withColumn("x", formats.extracting(adapters)(F.col("content"), F.lit("BARS"))), "bars")
    put = formats.emitting(adapters)
    return read.select("page_id", F.decode(put(F.encode(F.lit("%PDF-"), "UTF-8"), F.lit("PDF"), F.concat(F.lit("text of "), "page_id"))["content"], "UTF-8").alias("body"), F.decode(put("content", F.lit("BARS"), F.col("x.text"))["content"], "UTF-8").alias("custom"))


@row("SELECT event_id, pointer, text FROM (SELECT event_id, '/a~1b/~0/0' AS pointer, event_type AS text FROM events UNION ALL SELECT event_id, '/k', 'u' || user_id FROM events UNION ALL SELECT event_id, '/z/1/deep', '' FROM events)")
def json_leaves(spark, sf_dir):
    """The strings of nested JSON texts; numbers, booleans and nulls are no text."""
    body = F.to_json(F.struct(F.create_map(F.lit("~"), F.array("event_type")).alias("a/b"), F.concat(F.lit("u"), "user_id").alias("k"), F.from_json("props", "map<string,int>").alias("p"), F.array(F.struct(F.lit(True).alias("deep"), F.lit(1.5).alias("n")).cast("struct<deep:string,n:double>"), F.struct(F.lit("").alias("deep"), F.lit(2.5).alias("n"))).alias("z")))
    body = F.replace(body, F.lit('"deep":"true"'), F.lit('"deep":true'))
    leaves = _table(spark, sf_dir, "events").select("event_id", F.explode(side.json_text_leaves(body)).alias("x"))
    return leaves.select("event_id", "x.pointer", "x.text")


def _side_files(spark, files: dict[str, str]) -> str:
    folder = shared_dir(spark, "side").removeprefix("file:")
    batch.write_files(spark.createDataFrame([(n, bytearray(t.encode())) for n, t in files.items()], "output string, content binary"), folder)
    return folder


@row("SELECT id, 'Riyadh' AS text, 'geo.gazetteer_address_gated' AS source FROM place WHERE id % 2 = 0")
def side_files(spark, sf_dir):
    """Places and phrases from files: one city is listed as no personal data."""
    places = {"countries": [{"en": ["Saudi Arabia"]}], "cities": [{"ar": ["الرياض"], "en": [" Riyadh ", "Jeddah", "X"]}, {"en": ["Riyadh"]}]}
    folder = _side_files(spark, {"places.json": json.dumps(places), "phrases.txt": "# none of these\nADDRESS: jeddah\nCARD:Riyadh\n\n"})
    found = D.detect_rows(carrier(spark, sf_dir, "place"), "id", which=(), gazetteer=side.read_places(spark, f"{folder}/places.json"), suppressor=side.read_phrases(spark, f"{folder}/phrases.txt"))
    return found.select("id", "text", "source")


@row("SELECT n_nationkey || '.txt' AS file, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END::INT AS start, (CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END + 6 + length(n_nationkey::VARCHAR))::INT AS \"end\", 'EMAIL' AS kind, (SELECT count(*) FROM nation) AS files, (SELECT count(*) FROM nation) AS gold, (SELECT 2 * count(*) FROM nation) AS out_of_scope FROM nation")
def gold_files(spark, sf_dir):
    """Gold spans of files that stand in one of two folders, the first of which wins."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    mail, even = F.concat(F.lit("c"), "k", F.lit("@x.ae")), F.col("k") % 2 == 0
    first, second = (shared_dir(spark, "corpus").removeprefix("file:") for _ in range(2))
    texts = nations.select("k", F.concat("k", F.lit(".txt")).alias("output"), F.encode(F.concat(F.when(even, "é ").otherwise("éé "), mail), "UTF-8").alias("content"))
    batch.write_files(texts.where(even), first)
    batch.write_files(texts.withColumn("content", F.when(even, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("content"))), second)
    start = F.when(even, 3).otherwise(5)
    gold = nations.select(F.concat("k", F.lit(".txt")).alias("file"), F.explode(F.array(F.struct(start.alias("start"), F.lit("EMAIL").alias("kind")), F.struct(F.lit(1).alias("start"), F.lit("CARD").alias("kind")), F.struct(F.lit(0).alias("start"), F.lit("CARD").alias("kind")))).alias("g"), F.length(mail).alias("n"))
    path = shared_dir(spark, "gold")
    batch.write_jsonl(gold.select("file", "g.start", (F.col("g.start") + F.col("n")).alias("end"), "g.kind"), path)
    spans, _, counts = side.read_gold(spark, path, first, second)
    return spans.crossJoin(F.broadcast(counts))


def _request(key):
    """A chat request whose texts hold a key's mail address, beside structural strings that look like one."""
    mail = F.concat(F.lit("c"), key, F.lit("@x.ae"))
    block = F.struct(F.lit("s@x.ae").alias("type"), F.concat(F.lit("see "), mail).alias("text"))
    call = F.struct(F.struct(F.lit("n@x.ae").alias("name"), F.concat(F.lit("to "), mail).alias("arguments")).alias("function"))
    return F.to_json(F.struct(F.lit("m@x.ae").alias("model"), F.array(block).alias("system"), mail.alias("input"), F.array(F.struct(F.lit("r@x.ae").alias("role"), F.concat(F.lit("hi "), mail).alias("content"), F.array(call).alias("tool_calls"))).alias("messages")))


_REQUEST = """'{{"model": "m@x.ae", "system": [{{"type": "s@x.ae", "text": "see ' || {m} || '"}}], "input": "' || {m} || '", "messages": [{{"role": "r@x.ae", "content": "hi ' || {m} || '", "tool_calls": [{{"function": {{"name": "n@x.ae", "arguments": "to ' || {m} || '"}}}}]}}]}}'"""
_MAIL_OF = _token("EMAIL", "'c' || id || '@x.ae'")


@row(f"SELECT id, {_REQUEST.format(m=_MAIL_OF)} AS body, 1::INT AS records FROM contact")
def request_redacted(spark, sf_dir):
    """Chat requests: the words of persons are redacted, structural strings are not."""
    rows = carrier(spark, sf_dir, "contact").select("id", _request(F.col("id").cast("string")).alias("body"))
    return bodies.redact_bodies(rows, "body", "request", SECRET, TENANT, which=CONTACT).select("id", "body", F.size("records").alias("records"))


@row("SELECT id, " + _REQUEST.format(m="'c' || id || '@x.ae'") + " AS body FROM contact")
def response_restored(spark, sf_dir):
    """JSON bodies with tokens, restored in every string."""
    rows = stored(carrier(spark, sf_dir, "contact").select("id", _request(F.col("id").cast("string")).alias("body")), "bodies")
    done = stored(bodies.redact_bodies(rows, "body", "request", SECRET, TENANT, which=CONTACT).select("id", "body", "records"), "redacted")
    return bodies.restore_bodies(done.select("id", "body"), "body", stored(tokens.vault(done, "id"), "vault"))


@row(f"""SELECT id, CASE id % 4 WHEN 0 THEN 'restore' WHEN 2 THEN 'replace' WHEN 3 THEN 'deny' END AS decision,
CASE id % 4 WHEN 0 THEN '{{"path": "/a", "text": "x c' || id || '@x.ae"}}' WHEN 2 THEN '["' || {_MAIL_OF} || '", 1]' END AS new_payload FROM contact""")
def hook_payloads(spark, sf_dir):
    """What a hook gives back: a write's input with real values, a tool's result with tokens."""
    rows = carrier(spark, sf_dir, "contact").withColumn("mail", F.concat(F.lit("c"), "id", F.lit("@x.ae")))
    token = tokens.token_for("EMAIL", F.col("mail"), SECRET, TENANT)
    vault = stored(rows.select(token.alias("token"), F.col("mail").alias("value")), "vault")
    payload = F.element_at(F.array(F.concat(F.lit('{"path": "/a", "text": "x '), token, F.lit('"}')), F.lit('{"path": "/a"}'), F.concat(F.lit('["'), "mail", F.lit('", 1]')), F.concat(F.lit("curl "), "mail")), (F.col("id") % 4 + 1).cast("int"))
    given = rows.select("id", F.when(F.col("id") % 4 == 2, "PostToolUse").otherwise("PreToolUse").alias("event"), F.when(F.col("id") % 4 < 2, "Write").otherwise("Bash").alias("tool"), payload.alias("payload"))
    return guard.hook_decision(given, secret=SECRET, tenant=TENANT, vault=vault, which=CONTACT).select("id", "decision", "new_payload")


@row(f"SELECT kind, token, min_by(value, id) AS value, min_by(normalized, id) AS normalized FROM (SELECT id, 'EMAIL' AS kind, {_T_MAIL} AS token, {_MAIL} AS value, lower({_MAIL}) AS normalized FROM contact UNION ALL SELECT id, 'PHONE', {_T_PHONE}, {_PHONE}, {_PHONE} FROM contact) GROUP BY kind, token")
def vault_file(spark, sf_dir):
    """A vault saved as one encrypted file and loaded again; records of kinds that are gone are left out."""
    path = shared_dir(spark, "vault").removeprefix("file:") + "/vault"
    vault = tokens.vault(_anonymized(spark, sf_dir), "id").where("kind <> 'PHONE' or not value like '+%'")
    old = spark.createDataFrame([("GONE", "GONE_1", "x", "x")], "kind string, token string, value string, normalized string")
    side.save_vault(vault.unionByName(old), path, "secret")
    return side.load_vault(spark, path, "secret")


@row("SELECT id, 2::INT AS kinds, true AS same FROM contact")
def jsonl_written(spark, sf_dir):
    """Detections as JSON lines, written and read again."""
    found = D.detect(carrier(spark, sf_dir, "contact"), which=CONTACT).select("id", batch.detections_json().alias("detections"))
    path = shared_dir(spark, "jsonl")
    batch.write_jsonl(found, path)
    schema = "array<struct<kind:string,start:int,end:int,text:string,confidence:double,source:string>>"
    read = spark.read.schema("id long, detections string").json(path).withColumn("d", F.from_json("detections", schema))
    return read.select("id", F.size(F.array_distinct(F.transform("d", lambda x: x["kind"]))).alias("kinds"), F.forall("d", lambda x: (x["end"] - x["start"] == F.length(x["text"])) & (F.round(x["confidence"], 4) == x["confidence"])).alias("same"))


@row("SELECT id || '-' || s AS stream, n::INT AS blocks, last, 'x c' || id || '@x.ae! ' || CASE s WHEN 'response' THEN '|x c' || id || '@x.ae! ' ELSE '' END AS text FROM (SELECT id, s, CASE s WHEN 'call' THEN 5 ELSE 4 END AS n, s <> 'call' AS last FROM contact, unnest(['chat', 'call', 'response']) t(s))")
def stream_shapes(spark, sf_dir):
    """Tokens cut in two in chat chunks, tool calls and responses; raw streams are cut at blank lines first."""
    rows = carrier(spark, sf_dir, "contact").select("id", F.concat(F.lit("c"), "id", F.lit("@x.ae")).alias("mail"))
    token = tokens.token_for("EMAIL", F.col("mail"), SECRET, TENANT)
    # a table of a few MB is one partition: dealt out, all tasks have a share of it and of all that is built on it
    rows = stored(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("token", token), "tokens")
    data = lambda *parts: F.concat(F.lit("data: "), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n\n"))
    a, b = F.substring("token", 1, 9), F.substring("token", 10, 99)
    chat = lambda p: data('{"choices":[{"index":0,"delta":{"content":"', p, '"}}]}')
    call = lambda p: data('{"choices":[{"index":0,"delta":{"tool_calls":[{"index":2,"function":{"arguments":"', p, '"}}]}}]}')
    answer = lambda p: data('{"type":"response.output_text.delta","item_id":"i","delta":"', p, '"}')
    raws = {
        "chat": F.concat(chat(F.concat(F.lit("x "), a)), chat(F.concat(b, F.lit("! "))), data('{"usage":1}'), data("[DONE]")),
        "call": F.concat(call(F.concat(F.lit("x "), a)), call(b), call(F.lit("! ")), data('{"choices":[]}'), F.lit(": end")),
        "response": F.concat(answer(F.concat(F.lit("x "), a)), answer(F.concat(b, F.lit("! "))), data('{"type":"response.created"}'), data('{"type":"response.completed","response":{"text":"|x ', F.col("token"), '! "}}')),
    }
    raw = rows.select(F.explode(F.array(*[F.struct(F.concat_ws("-", "id", F.lit(s)).alias("stream_id"), r.alias("raw")) for s, r in raws.items()])).alias("s")).select("s.*")
    blocks = events.event_blocks(raw)
    done = events.restore_batch(blocks, rows.select("token", F.col("mail").alias("value")))
    # what is no object is not parsed, which would fail slowly, and silent blocks add nothing to a text
    done = done.withColumn("body", F.when(F.col("block").startswith("data: {"), F.substring("block", 7, 2**31 - 1)))
    shape = "choices array<struct<delta:struct<content:string,tool_calls:array<struct<function:struct<arguments:string>>>>>>, delta string, response struct<text:string>"
    done = done.withColumn("e", F.from_json("body", shape))  # one parse for all places of a text
    first = F.get("e.choices", F.lit(0))["delta"]
    said = F.coalesce(first["content"], F.get(first["tool_calls"], F.lit(0))["function"]["arguments"], F.col("e.delta"), F.col("e.response.text"), F.lit(""))
    told = done.select(F.col("stream_id").alias("stream"), "seq", "part", F.explode(F.filter(F.array(said), lambda t: t != "")).alias("t"))
    texts = told.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "t"))), lambda x: x["t"]), "").alias("text"))
    counts = blocks.groupBy(F.col("stream_id").alias("stream")).agg(F.count("*").cast("int").alias("blocks"), F.max_by(events.is_last(F.col("block")), "seq").alias("last"))
    return counts.join(texts, "stream", "left").select("stream", "blocks", "last", F.coalesce("text", F.lit("")).alias("text"))


def _run(writer, spark, name: str) -> None:
    writer.option("checkpointLocation", shared_dir(spark, name)).trigger(availableNow=True).start().awaitTermination()


_EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"


def _all_given(writer, spark, name: str) -> None:
    """Runs a stream with timeouts until all of its input is through, however long that takes; a failure is raised.

    Batches without data, which only let timeouts pass, would go on for ever: the query begins without them.
    """
    before = spark.conf.get(_EMPTY)
    spark.conf.set(_EMPTY, "false")
    try:
        query = writer.option("checkpointLocation", shared_dir(spark, name)).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_EMPTY, before)
    query.awaitTermination()


@row("SELECT conv_id, turn, 'mail ' || " + _token("EMAIL", "'u' || conv_id || '@x.ae'") + " || ' ' || text AS text FROM conversations")
def live_redaction(spark, sf_dir):
    """A running stream of turns, redacted as it comes."""
    rows = stored(_table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.lit("mail u"), "conv_id", F.lit("@x.ae "), "text")), "turns")
    stream = spark.readStream.schema(rows.schema).parquet(rows.stored_at)
    out = shared_dir(spark, "live") + "/table"
    done = events.redact_stream(stream, "text", SECRET, tenant=TENANT, which=D.detectors("EMAIL")).select("conv_id", "turn", "text")
    _run(done.writeStream.format("parquet").option("path", out), spark, "live-checkpoint")
    return spark.read.schema(done.schema).parquet(out)


@row("SELECT id, text FROM contact")
def live_restore(spark, sf_dir):
    """A running stream of events whose tokens are cut, joined with the vault as it is at each batch."""
    done, vault = _round_trip(spark, sf_dir)
    chunk = lambda body: F.concat(F.lit('data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"'), body, F.lit('"}}'))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 11).cast("int")), lambda i: F.struct(i.cast("long").alias("seq"), chunk(F.substr("text", i * 11 + 1, F.lit(11))).alias("block")))
    last = F.array(F.struct(F.size(parts).cast("long").alias("seq"), F.lit('data: {"type":"message_stop"}').alias("block")))
    blocks = stored(done.select(F.col("id").cast("string").alias("stream_id"), F.explode(F.concat(parts, last)).alias("e")).select("stream_id", "e.*"), "events")
    out = shared_dir(spark, "restored") + "/table"

    def write(df, n):  # a batch that comes again takes the place of itself
        df.write.mode("overwrite").parquet(f"{out}/n={n}")

    writer = events.restore_stream(spark.readStream.schema(blocks.schema).parquet(blocks.stored_at), lambda: vault, write, fuzzy=False)
    _all_given(writer, spark, "restore-checkpoint")
    said = spark.read.schema("stream_id string, seq long, part int, block string, n int").parquet(out)
    delta = F.get_json_object(F.regexp_replace("block", "^data: ", ""), "$.delta.text")
    joined = said.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", F.coalesce(delta, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"))
    return joined.select(F.col("stream_id").cast("long").alias("id"), "text")
