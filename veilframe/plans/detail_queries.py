"""Registered queries of single functions, detectors and span operations, each with its SQL."""

# ruff: noqa: E501

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, text
from ..operators import detect as D
from ..operators import keys, ner, restore, spans, structured, tokens
from ..session import shared_dir, stored
from ..sources import side
from . import evaluate, tiny_model
from .carriers import carrier
from .queries import CONTACT, SECRET, TENANT, _anonymized, _found, _round_trip, _spans, _table
from .queries_sql import _DONE, _INTL, _MAIL, _PHONE, _T_INTL, _T_MAIL, _T_PHONE, _token
from .queries_sql import _spans as _span_sql

QUERIES, SQL = {}, {}


def row(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(query):
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return add


_NAME = "translate(id::VARCHAR, '0123456789', 'abcdefghij')"
for _name, _carrier, _kind, _value, _source, _when in (
    ("gulf_id_spans", "gulf_id", "NATIONAL_ID", "'8' || lpad(id::VARCHAR, 8, '0')", "regex.gcc.id_context", "id % 2 = 0"),
    ("bare_vat_spans", "bare_vat", "TAX_NUMBER", "'3' || lpad(id::VARCHAR, 13, '0') || '3'", "regex.saudi_vat_bare", "id % 2 = 0"),
    ("labelled_address_spans", "labelled", "ADDRESS", "'Tower ' || id || ' Palm Zone'", "regex.address_context", "id % 3 = 0"),
    ("building_spans", "building", "ADDRESS", "'B-' || id", "regex.address_building", "id % 2 = 0"),
    ("postal_code_spans", "postal", "ADDRESS", "(10000 + id % 80000)::VARCHAR", "regex.address_postal_code", "id % 2 = 0"),
    ("district_spans", "district", "ADDRESS", f"'District Ol' || {_NAME}", "regex.address_district", "id % 2 = 0"),
    ("street_spans", "street", "ADDRESS", f"'Palm' || {_NAME}", "regex.address_street", "id % 2 = 0"),
    ("arabic_street_spans", "arabic_street", "ADDRESS", "'شارع Palm' || id", "regex.address_arabic_keyword", "id % 2 = 0"),
    ("compound_spans", "compound", "ADDRESS", "'حي النخيل، شارع Palm' || id || '، الرياض 12345'", "regex.address_compound", "id % 2 = 0"),
    ("city_anchor_spans", "anchor", "ADDRESS", "'Palm ' || id || ' Plaza, Riyadh'", "regex.address_city_anchor", "id % 2 = 0"),
    ("english_street_spans", "road", "ADDRESS", f"'King Palm' || {_NAME} || ' Road'", "regex.address_english_street", "id % 2 = 0"),
    ("letters_iban_spans", "letters_iban", "IBAN", "'QA11ABCDEFGHIJKLMNOPQRSTUVWXY'", "regex.gcc.iban.mod97", "id % 2 = 0"),
):
    QUERIES[_name] = lambda s, d, c=_carrier, k=_kind: _spans(s, d, c, k)
    SQL[_name] = _span_sql(_carrier, [(_value, _kind, _source, _when)])


@row("SELECT id, 0::INT AS start, (9 + length(id::VARCHAR))::INT AS \"end\", 'شارع Palm' || id AS text, 'عراش Palm' || id AS value FROM turned WHERE id % 2 = 0")
def turned_spans(spark, sf_dir):
    """Found in the turned reading: its text is the turned one, what is replaced the text as it stands."""
    return _found(spark, sf_dir, "turned", "ADDRESS").select("id", "start", "end", "text", F.col("compat").alias("value"))


@row("SELECT id, 'عربي' AS word, CASE id % 4 WHEN 0 THEN (id % 10)::VARCHAR WHEN 1 THEN (id % 10)::VARCHAR WHEN 2 THEN (id % 10)::VARCHAR END AS digit, id % 2 = 0 AS letter, id % 3 <> 1 AS arabic FROM (SELECT c_custkey AS id FROM customer)")
def character_functions(spark, sf_dir):
    n = F.col("id") % 10
    t = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    c = F.substr(F.element_at(F.array(F.lit("0123456789"), F.lit("٠١٢٣٤٥٦٧٨٩"), F.lit("۰۱۲۳۴۵۶۷۸۹"), F.lit("abcdefghij")), (F.col("id") % 4 + 1).cast("int")), (n + 1).cast("int"), F.lit(1))
    letter = F.when(F.col("id") % 2 == 0, "ب").otherwise("b")
    word = F.element_at(F.array(F.lit("كلمة-أخرى"), F.lit("كلمة a"), F.lit("كَلِمَة")), (F.col("id") % 3 + 1).cast("int"))
    return t.select("id", F.lit("عربي").alias("word"), text.ascii_digit(c).alias("digit"), text.is_arabic_letter(letter).alias("letter"), text.is_arabic_word(word).alias("arabic"))


@row("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (props->>'$.k')::BIGINT ELSE -1 END AS n FROM events")
def json_numbers(spark, sf_dir):
    """Whole numbers of JSON texts; strings and fractions give the default."""
    raw = F.element_at(F.array(F.get_json_object("props", "$.k"), F.concat(F.lit('"'), F.get_json_object("props", "$.k"), F.lit('"')), F.concat(F.get_json_object("props", "$.k"), F.lit(".0"))), (F.col("event_id") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", text.json_int(raw, -1).alias("n"))


@row("SELECT doc_id, len(string_split(text || chr(8232) || 'x', chr(10)))::INT AS lines FROM documents")
def lf_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(text.lf_lines(F.concat("text", F.lit(" x")))).alias("lines"))


@row("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM pages")
def xml_escapes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(text.xml_escape(F.col("html")), 256).alias("escaped"))


@row("SELECT table_name AS name, 'PERSON' AS kind, count(*)::INT AS n FROM information_schema.columns WHERE column_name LIKE '%name%' AND table_name IN ('customer', 'supplier', 'part', 'nation', 'region', 'orders', 'documents', 'labels') GROUP BY 1")
def table_headers(spark, sf_dir):
    """The telling columns of each table."""
    rows = [(t, k, n) for t in ("customer", "supplier", "part", "nation", "region", "orders", "documents", "labels") for k, n in sorted(keys.table_kinds(_table(spark, sf_dir, t).columns).items())]
    return spark.createDataFrame(rows, "name string, kind string, n int")


@row("SELECT id, id % 4 IN (0, 1) AS kept FROM contact")
def kept_values(spark, sf_dir):
    n = F.lpad(F.col("id").cast("string"), 16, "0")
    value = F.element_at(F.array(F.concat(F.lit(" EMAIL_"), n, F.lit(" ")), F.concat(F.lit("GOV_A"), n), F.concat(F.lit("EMAIL_x"), n), F.concat(F.lit("see EMAIL_"), n)), (F.col("id") % 4 + 1).cast("int"))
    return carrier(spark, sf_dir, "contact").select("id", checks.kept_value(value).alias("kept"))


@row("SELECT id, s::INT AS start, e::INT AS \"end\" FROM (SELECT id, id % 5 AS s, id % 7 AS e FROM contact) WHERE s < e")
def valid_spans(spark, sf_dir):
    """Spans without a character are none."""
    d = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit("EMAIL").alias("kind"), F.lit("x").alias("text"), F.lit(0.9).alias("confidence"), F.lit("s").alias("source"), F.lit(0).alias("ord"), F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("double").alias("base"), F.lit(None).cast("double").alias("boost"), F.lit(None).cast("array<string>").alias("matched_terms"), F.lit("x").alias("compat"))
    found = carrier(spark, sf_dir, "contact").select("id", F.explode(spans.resolve(F.array(d(F.col("id") % 5, F.col("id") % 7)))).alias("d"))
    return found.select("id", "d.start", "d.end")


@row("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 'hm' FROM conversations WHERE role = 'assistant'")
def assistant_messages(spark, sf_dir):
    """Texts and thoughts of the assistant's lines of a transcript."""
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), (body if kind == "text" else F.lit(None).cast("string")).alias("text"), (body if kind == "thinking" else F.lit(None).cast("string")).alias("thinking"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("timestamp"), F.struct(F.array(block("text", F.col("text")), block("thinking", F.lit("hm")), block("image", F.lit("x"))).alias("content")).alias("message")))
    said = side.assistant_messages(_table(spark, sf_dir, "conversations").select(line.alias("value")), thinking=True)
    return said.select(F.split("timestamp", "-")[0].cast("long").alias("conv_id"), F.split("timestamp", "-")[1].cast("long").alias("turn"), "text")


def _gold(spark, sf_dir):
    texts = carrier(spark, sf_dir, "folded").select(F.concat("id", F.lit(".txt")).alias("file"), "text")
    gold = carrier(spark, sf_dir, "folded").select(F.concat("id", F.lit(".txt")).alias("file"), F.when(F.col("id") % 5 == 0, 10).otherwise(9).alias("start"), F.lit(29).alias("end"), F.when(F.col("id") % 3 == 0, "CARD").otherwise("PHONE").alias("kind"))
    return gold.unionByName(gold.limit(0)), texts


@row("SELECT id || '.txt' AS file, 5::INT AS start, 15::INT AS \"end\", 'PHONE' AS kind FROM folded WHERE id % 3 <> 0 AND id % 5 <> 0")
def gold_spans(spark, sf_dir):
    """Byte offsets to code points; spans inside a character and of other kinds are left out."""
    return side.gold_spans(*_gold(spark, sf_dir))


@row("SELECT count(*) AS files, count(*) FILTER (id % 3 <> 0 AND id % 5 <> 0) AS gold, count(*) FILTER (id % 3 = 0) AS out_of_scope FROM folded")
def gold_counts(spark, sf_dir):
    return side.gold_counts(*_gold(spark, sf_dir))


@row("SELECT 'EMAIL' AS kind, 'regex.email' AS source, (count(*) FILTER (id % 3 <> 0))::BIGINT AS tp, (count(*) FILTER (id % 3 = 0))::BIGINT AS fp FROM contact UNION ALL SELECT 'PHONE', 'regex.gcc.phone', 0, 2 * count(*) FROM contact")
def eval_by_source(spark, sf_dir):
    found = stored(_found(spark, sf_dir, "contact", "EMAIL", "PHONE").select("id", "start", "end", "kind", "source"), "found")
    gold = carrier(spark, sf_dir, "contact").select("id", (F.locate("email ", F.col("text")) + 5).alias("start"), (F.locate("@", F.col("text")) + 2).alias("end"), F.lit("EMAIL").alias("kind"))
    return evaluate.scores(evaluate.outcomes(found, gold.where("id % 3 <> 0"), "id"), "kind", "source").select("kind", "source", "tp", "fp")


@row("SELECT arg_max(event_type || '-' || event_id, ts) AS path FROM events")
def newest_file(spark, sf_dir):
    return side.newest(_table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", "event_id").alias("path"), F.col("ts").alias("modificationTime")))


@row(f"SELECT id, array_to_string(list_sort([{_T_MAIL}, {_T_PHONE}, {_T_INTL}]), ',') AS tokens FROM contact")
def sorted_records(spark, sf_dir):
    return _anonymized(spark, sf_dir).select("id", F.array_join(F.transform("records", lambda r: r["token"]), ",").alias("tokens"))


@row(f"SELECT 'EMAIL' AS kind, {_T_MAIL} AS token, id % 2 = 0 AS old FROM contact UNION ALL SELECT 'PHONE', {_T_PHONE}, id % 2 = 0 FROM contact UNION ALL SELECT 'PHONE', {_T_INTL}, id % 2 = 0 FROM contact")
def vault_upsert(spark, sf_dir):
    """A vault of half the rows, and what the other half adds to it."""
    done = stored(_anonymized(spark, sf_dir).select("id", "records"), "anonymized")
    old = tokens.vault(done.where("id % 2 = 0"), "id").withColumn("value", F.lit("old"))
    return tokens.upsert(old, tokens.vault(done, "id")).select("kind", "token", (F.col("value") == "old").alias("old"))


@row(f"SELECT id, CASE WHEN id % 2 = 0 THEN replace({_DONE}, {_T_MAIL}, 'EMAIL_' || lpad(id::VARCHAR, 16, '0')) ELSE {_DONE} END AS text FROM contact")
def anonymize_known(spark, sf_dir):
    """An earlier vault's tokens go on being used for its values."""
    old = carrier(spark, sf_dir, "contact").where("id % 2 = 0").select(F.lit("EMAIL").alias("kind"), F.concat(F.lit("c"), "id", F.lit("@mail.example.ae")).alias("normalized"), F.concat(F.lit("EMAIL_"), F.lpad(F.col("id").cast("string"), 16, "0")).alias("token"))
    return _anonymized(spark, sf_dir, known=old).select("id", "text")


_PARTS = f"['Client ' || substr(text, 8, strpos(text, ' phone ') - 8) || ' phone ', {_PHONE}, ' email ', {_MAIL}, ', ', {_INTL}, ' end']"


@row(f"SELECT id, p::INT - 1 AS pos, CASE p WHEN 2 THEN 'PHONE' WHEN 4 THEN 'EMAIL' WHEN 6 THEN 'PHONE' END AS kind, {_PARTS}[p] AS text FROM contact, range(1, 8) r(p)")
def text_segments(spark, sf_dir):
    """Plain and entity pieces of a text in turn."""
    found = D.detect(carrier(spark, sf_dir, "contact"), which=CONTACT)
    return found.select("id", F.posexplode(spans.segments(F.col("text"), F.col("detections"))).alias("pos", "s")).select("id", "pos", "s.kind", "s.text")


@row(f"SELECT id, kind, source, text FROM (SELECT id, 'PERSON' AS kind, 'first' AS source, 'Client' AS text FROM contact UNION ALL SELECT id, 'EMAIL', 'regex.email', {_MAIL} FROM contact UNION ALL SELECT id, 'ADDRESS', 'second', 'end' FROM contact)")
def engine_merge(spark, sf_dir):
    """Model detections are merged in order, each where nothing is yet: one into an e-mail address and one into an earlier model's name are not."""

    def engine(name, kind, *words):
        def run(source):
            at = lambda w: F.instr(source, w) - 1
            return F.array(*[F.struct(at(w).cast("int").alias("start"), (at(w) + len(w)).cast("int").alias("end"), F.lit(kind).alias("kind"), F.lit(w).alias("text"), F.lit(0.9).alias("confidence"), F.lit(name).alias("source"), F.lit(i).alias("ord"), F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("double").alias("base"), F.lit(None).cast("double").alias("boost"), F.lit(None).cast("array<string>").alias("matched_terms"), F.lit(w).alias("compat")) for i, w in enumerate(words)])

        return run

    engines = [engine("first", "PERSON", "Client", "Mail.example"), engine("second", "ADDRESS", "lient", "end")]
    return D.detect_rows(carrier(spark, sf_dir, "contact"), "id", which=D.detectors("EMAIL"), engines=engines).select("id", "kind", "source", "text")


@row("SELECT id, replace(replace(replace('call ' || id || ' abc abab', 'abc', '2'), 'ab', '1'), 'call', 'ring') AS text, '[{\"needle\":\"call\",\"n\":1},{\"needle\":\"abc\",\"n\":1},{\"needle\":\"ab\",\"n\":2}]' AS hits FROM contact")
def longest_first(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(a).alias("needle"), F.lit(b).alias("value")) for a, b in (("ab", "1"), ("abc", "2"), ("", "x"), ("zz", "3"), ("call", "ring"))])
    done = carrier(spark, sf_dir, "contact").select("id", tokens.replace_longest_first(F.concat(F.lit("call "), "id", F.lit(" abc abab")), pairs).alias("r"))
    return done.select("id", "r.text", F.to_json("r.hits").alias("hits"))


@row("SELECT doc_id, w::INT AS \"window\", least(500, n - 500 * w)::INT AS pieces FROM (SELECT doc_id, len(string_split(text, ' ')) AS n, unnest(range(0, (len(string_split(text, ' ')) + 499) // 500)) AS w FROM documents)")
def token_windows(spark, sf_dir):
    pieces = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "piece"))
    return ner.token_windows(pieces, "doc_id").groupBy("doc_id", "window").agg((F.max("place") + 1).cast("int").alias("pieces"))


_LABELS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "E-LOC", "S-PERS", "B-MISC", "I-PER", "O"]


@row(f"""
, w AS (SELECT id, i, i::BIGINT * 10 AS s, i::BIGINT * 10 + 9 AS e, {_LABELS!r}[(i * i + id) % 10 + 1] AS l, CASE WHEN (i + id) % 3 = 0 THEN 1.0 ELSE 0.75 END AS p, (i * 7 + id) % 4 = 1 AS link FROM (SELECT conv_id * 100 + turn AS id, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations)),
k AS (SELECT *, CASE WHEN l = 'O' THEN 'O' WHEN l[1] IN ('B', 'S') THEN 'B' ELSE 'I' END AS t, CASE l[3:] WHEN 'PER' THEN 'PERSON' WHEN 'PERS' THEN 'PERSON' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'LOC' THEN 'ADDRESS' WHEN 'MISC' THEN 'OTHER' ELSE '' END AS kind FROM w),
z AS (SELECT id, list(struct_pack(s := s, e := e, t := t, k := kind, p := p, link := link, run := 0, cur := '', br := false, own := true) ORDER BY i) AS ws FROM k GROUP BY id),
r(id, ws, n, cur, run, br, made) AS (SELECT id, ws, 0, '', 0, false, []::STRUCT(run INTEGER, s BIGINT, e BIGINT, k VARCHAR, p DECIMAL(3, 2), own BOOLEAN)[] FROM z
  UNION ALL SELECT id, ws, n + 1,
    CASE WHEN ws[n + 1].link AND cur = 'PERSON' THEN cur ELSE ws[n + 1].k END,
    CASE WHEN (ws[n + 1].link AND cur = 'PERSON') OR (ws[n + 1].t <> 'O' AND cur = ws[n + 1].k AND (ws[n + 1].t = 'I' OR br)) THEN run ELSE run + 1 END,
    ws[n + 1].link AND cur = 'PERSON',
    list_append(made, struct_pack(run := CASE WHEN (ws[n + 1].link AND cur = 'PERSON') OR (ws[n + 1].t <> 'O' AND cur = ws[n + 1].k AND (ws[n + 1].t = 'I' OR br)) THEN run ELSE run + 1 END, s := ws[n + 1].s, e := ws[n + 1].e, k := ws[n + 1].k, p := ws[n + 1].p, own := NOT (ws[n + 1].link AND cur = 'PERSON')))
  FROM r WHERE n < len(ws)),
m AS (SELECT id, unnest(made) AS x FROM r WHERE n = len(ws))
SELECT id, min(x.s)::INT AS start, max(x.e)::INT AS "end", arg_min(x.k, x.s) FILTER (x.own) AS kind, round(avg(x.p) FILTER (x.own), 6) AS p FROM m GROUP BY id, x.run HAVING avg(x.p) FILTER (x.own) >= 0.8 AND arg_min(x.k, x.s) FILTER (x.own) IN ('PERSON', 'ORGANIZATION', 'ADDRESS')
""")
def entity_runs(spark, sf_dir):
    """Words of whole turns with labels from their place: runs, names' connectives and mean probabilities."""
    words = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.posexplode(F.split("text", " ", -1)).alias("i", "w"))
    label = F.element_at(F.array(*map(F.lit, _LABELS)), ((F.col("i") * F.col("i") + F.col("id")) % 10 + 1).cast("int"))
    given = words.select("id", "i", (F.col("i") * 10).cast("int").alias("start"), (F.col("i") * 10 + 9).cast("int").alias("end"), label.alias("label"), F.when((F.col("i") + F.col("id")) % 3 == 0, 1.0).otherwise(0.75).alias("p"), F.when((F.col("i") * 7 + F.col("id")) % 4 == 1, "Bin").otherwise("x").alias("surface"))
    return ner.entity_runs(given, "id", 0.8).withColumn("p", F.round("p", 6))


@row("SELECT id, '05' || lpad(id::VARCHAR, 8, '0') AS phone, 'mail c' || id || '@x.ae' AS note, id AS k FROM contact")
def structured_restored(spark, sf_dir):
    """Nested columns of any type, redacted and restored."""
    rows = carrier(spark, sf_dir, "contact").select("id", F.struct(F.concat(F.lit("05"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("phone"), F.array(F.concat(F.lit("mail c"), "id", F.lit("@x.ae"))).alias("notes"), F.create_map(F.lit("k"), "id").alias("m")).alias("c"))
    done = stored(structured.redact_structured(rows, SECRET, TENANT, ["c"], which=CONTACT), "redacted")
    values = rows.select(F.explode(F.array(F.struct(tokens.token_for("PHONE", F.col("c.phone"), SECRET, TENANT).alias("token"), F.col("c.phone").alias("value")), F.struct(tokens.token_for("EMAIL", F.concat(F.lit("c"), "id", F.lit("@x.ae")), SECRET, TENANT).alias("token"), F.concat(F.lit("c"), "id", F.lit("@x.ae")).alias("value")))).alias("v")).select("v.*")
    out = structured.restore_structured(done, stored(values, "vault"), ["c"])
    return out.select("id", "c.phone", F.col("c.notes")[0].alias("note"), F.col("c.m")["k"].alias("k"))


@row(f"SELECT id % 7 AS id, text, 3::INT AS restored FROM contact UNION ALL SELECT NULL, text, 3 FROM contact UNION ALL SELECT id % 7, 'twice ' || {_MAIL} || {_MAIL}, 1 FROM contact")
def restore_repeated(spark, sf_dir):
    """Rows that share an id, or have none, are each restored on their own."""
    done, vault = _round_trip(spark, sf_dir)
    few = done.select((F.col("id") % 7).alias("id"), "text")
    mail = done.select((F.col("id") % 7).alias("id"), F.concat(F.lit("twice "), *[F.regexp_extract("text", "(EMAIL_[A-F0-9]{16})", 1)] * 2).alias("text"))
    return restore.restore(few.unionByName(few.withColumn("id", F.lit(None).cast("long"))).unionByName(mail), vault, fuzzy=False).select("id", "text", F.size("restored").alias("restored"))


_SURE = "round(exp(10.0) / (exp(10.0) + 4), 4)"


@row(f"""SELECT id, kind, source, text, {_SURE} AS confidence FROM (SELECT id, 'PERSON' AS kind, 'ner.onnx' AS source, 'Khalid bin Sultan' AS text FROM contact WHERE id % 2 = 0 UNION ALL SELECT id, 'ORGANIZATION', 'ner.onnx', 'Acme' FROM contact WHERE id % 2 = 0
UNION ALL SELECT id, 'ADDRESS', 'ner.onnx', 'Riyadh' FROM contact WHERE id % 2 = 0 UNION ALL SELECT id, 'PERSON', 'ner.onnx.caseaug', 'khalid' FROM contact WHERE id % 2 = 1)""")
def model_spans(spark, sf_dir):
    """A model's names, organisations and places; in text without capitals the names of its title-cased form."""
    folder = tiny_model.write(shared_dir(spark, "model").removeprefix("file:"))
    body = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Khalid bin Sultan of Acme in Riyadh, "), "id")).otherwise(F.concat(F.lit("khalid of acme "), "id"))
    rows = carrier(spark, sf_dir, "contact").select("id", body.alias("text"))
    return D.detect_rows(rows, "id", which=(), engines=[ner.engine(folder)]).select("id", "kind", "source", "text", F.round("confidence", 4).alias("confidence"))
