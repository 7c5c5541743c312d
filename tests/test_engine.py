"""The privacy engine: detectors, tokens, restore, formats, streams, scoring, and the package itself."""

import csv
import io
import json
import random
import re
import sys
import time
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veilframe import catalog, fixed
from veilframe.functions import checks, text
from veilframe.model import Policy
from veilframe.operators import detect as D
from veilframe.operators import bodies, guard, ner, restore, structured, tokens
from veilframe.plans import batch, evaluate, folder_queries
from veilframe.session import dropped, scratch, stored
from veilframe.sources import formats, side
from veilframe.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CONTACT = D.detectors("EMAIL", "PHONE")
TOKEN = "EMAIL_18686338BC2AD87A"
VAULT = {TOKEN: "a@b.co"}


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def found(spark, texts, **options):
    rows = D.detect_rows(frame(spark, texts), "id", **options).collect()
    return sorted((r.id, r.start, r.end, r.kind, r.text) for r in rows)


def value(spark, column, *args):
    return spark.range(1).select(column(*[F.lit(a) for a in args]).alias("v")).first().v


def test_all_queries_equal_their_sql(spark):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    wrong = []
    for name, sql in catalog.ORACLE_SQL.items():
        df = catalog.QUERIES[name](spark, SF)
        got = db.execute(sql)
        names = [d[0] for d in got.description]
        key = lambda r: tuple(map(str, r))
        want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in got.fetchall()), key=key)
        have = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
        if sorted(df.columns) != sorted(names) or have != want:
            wrong.append(name)
    assert wrong == []


def test_detection(spark):
    assert found(spark, ["to QA11ABCDEFGHIJKLMNOPQRSTUVWXY x", "QA 11-ABCDEFGHIJKLMNOPQRSTUVWXY"], which=D.detectors("IBAN", "PHONE")) == [(0, 3, 32, "IBAN", "QA11ABCDEFGHIJKLMNOPQRSTUVWXY"), (1, 0, 31, "IBAN", "QA 11-ABCDEFGHIJKLMNOPQRSTUVWXY")]
    texts = [
        "write to Fatima@Example.AE please", "phone 0501234567 and +966512345678  1010123456", "+(965) 1 85 85 85", "00965 – 23983661", "Order 24145989 shipped", "IBAN SA0380000000608010167519 x", "IBAN SA0380000000608010167518 x",
        "جوال ٠٥٠١٢٣٤٥٦٧", "Emirates ID 784-1990-1234567-1", "Commercial Registration (CR) Number: 1010032264", "VAT number: 300000000000003", "EMAIL_18686338BC2AD87A", None, "", " a@b.co ", "مَحمد a@b.co",
    ]
    got = found(spark, texts)
    assert got == [
        (0, 9, 26, "EMAIL", "Fatima@Example.AE"), (1, 6, 16, "PHONE", "0501234567"), (1, 21, 34, "PHONE", "+966512345678"), (2, 0, 17, "PHONE", "+(965) 1 85 85 85"), (3, 0, 16, "PHONE", "00965 – 23983661"),
        (5, 5, 29, "IBAN", "SA0380000000608010167519"), (7, 5, 15, "PHONE", "٠٥٠١٢٣٤٥٦٧"), (8, 12, 30, "NATIONAL_ID", "784-1990-1234567-1"), (9, 37, 47, "COMMERCIAL_REGISTRATION", "1010032264"), (10, 12, 27, "TAX_NUMBER", "300000000000003"),
        (14, 2, 8, "EMAIL", "a@b.co"), (15, 6, 12, "EMAIL", "a@b.co"),
    ]


def test_turned_arabic_text_is_read_both_ways(spark):
    turned = "شارع الملك"[::-1]
    line = " ".join(w[::-1] for w in "شارع الملك".split())
    assert found(spark, [line], which=D.detectors("ADDRESS"))[0][3] == "ADDRESS" and turned != line


def test_checksums(spark):
    assert [value(spark, checks.luhn, d) for d in ("4111111111111111", "4111111111111112", "0000000000000000", "")] == [True, False, False, False]
    assert [value(spark, checks.mod97, s) for s in ("80000000608010167519SA03", "a", "")] == [1, -1, 0]
    assert value(spark, checks.valid_iban, "sa03 8000 0000 6080 1016 7519") and not value(spark, checks.valid_iban, "GB82WEST12345698765432")
    digits = "28901010001"
    check = 11 - sum(int(c) * w for c, w in zip(digits, fixed.KUWAIT_WEIGHTS)) % 11
    assert value(spark, checks.kuwait_mod11, f"{digits}{check}") == (check <= 9) and not value(spark, checks.kuwait_mod11, "123")


def test_text_functions(spark):
    assert value(spark, text.scrub, "a​b­а") == "aba"
    assert value(spark, text.normalize_arabic, "  الإِدَارَة  ﷺ ١٢ ") == "الاداره صلي الله عليه وسلم 12"
    assert value(spark, text.title_variant, "mark mcDonald x1y") == "Mark McDonald X1Y"
    assert value(spark, text.strip_particles, "والكتاب") == "كتاب" and value(spark, text.strip_particles, "ولد") == "ولد"
    assert value(spark, text.safe_split, "hi EMAIL_1") == 3 and value(spark, text.safe_split, "A" * 65) == 65
    assert value(spark, text.is_arabic_word, "كلمة-أخرى") and not value(spark, text.is_arabic_word, "كلمة a")
    assert value(spark, text.xml_escape, "<a&\"'>") == "&lt;a&amp;&quot;&apos;&gt;" and value(spark, text.byte_to_char, "é€x", 5) == 2 and value(spark, text.byte_to_char, "é€x", 3) is None


def test_known_tokens_and_sessions(spark):
    t = lambda k, v, *a: spark.range(1).select(tokens.token_for(k, F.lit(v), *a).alias("t")).first().t
    assert t("EMAIL", "ahmed@example.ae", "test-secret", "tenant-a") == "EMAIL_18686338BC2AD87A"
    assert t("PHONE", "0501234567", "test-secret", "tenant-a") == "PHONE_D9E4E10C9DD1E02E"
    assert t("PHONE", "0501234567", "test-secret", "tenant-a", "s") != "PHONE_D9E4E10C9DD1E02E"
    assert t("EMAIL", " AHMED@example.ae ", "test-secret", "tenant-a") == "EMAIL_18686338BC2AD87A"


def test_round_trip_vault_and_idempotence(spark):
    df = frame(spark, ["mail Ahmed@Example.ae, ahmed@example.ae or 0501234567", "none", None, ""])
    done = stored(tokens.anonymize(df, "text", "s", "t", which=CONTACT), "test")
    vault = stored(tokens.vault(done, "id"), "test")
    assert {r.value for r in vault.collect()} == {"Ahmed@Example.ae", "0501234567"}
    back = {r.id: r for r in restore.restore(done.select("id", "text"), vault).collect()}
    assert back[0].text == "mail Ahmed@Example.ae, Ahmed@Example.ae or 0501234567" and back[1].text == "none" and back[2].text is None and back[3].text == ""
    again = tokens.anonymize(done.select("id", "text"), "text", "s", "t", which=CONTACT)
    assert sorted(again.select("text").collect(), key=str) == sorted(done.select("text").collect(), key=str)
    assert guard.residual(done.select("id", "text"), which=CONTACT).where("residual > 0").count() == 0
    old = spark.createDataFrame([("EMAIL", "EMAIL_AAAAAAAAAAAAAAAA", "x", "ahmed@example.ae")], "kind string, token string, value string, normalized string")
    kept = tokens.anonymize(df, "text", "s", "t", which=CONTACT, known=old).where("id = 0").first().text
    assert kept.count("EMAIL_AAAAAAAAAAAAAAAA") == 2 and tokens.upsert(old, vault).count() == 3


def test_nearest_token(spark):
    vault = spark.createDataFrame([("EMAIL_18686338BC2AD87A", "a@b.co"), ("PHONE_D9E4E10C9DD1E02E", "holds EMAIL_18686338BC2AD87A")], "token string, value string")
    texts = ["EMAIL_18686338BC2AD87", "EMAIL_8686338BC2AD8A", "EMAIL_28686338BC2AD87B", "EMAIL_DEADBEEF1234", "PHONE_D9E4E10C9DD1E02E", "EMAIL_18686338BC2AD87AFF"]
    got = {r.id: r for r in restore.restore(frame(spark, texts), vault).collect()}
    assert [got[i].text for i in range(6)] == ["a@b.co", "a@b.co", "a@b.co", "EMAIL_DEADBEEF1234", "holds a@b.co", "a@b.co"]
    assert got[3].unrestored == ["EMAIL_DEADBEEF1234"] and got[0].restored == ["EMAIL_18686338BC2AD87A"]


def test_a_restored_table_has_a_small_plan(spark):
    """A plan that repeats every step of the look-up fills the driver."""
    vault = spark.createDataFrame([("EMAIL_18686338BC2AD87A", "a@b.co")], "token string, value string")
    with scratch() as made:
        out = restore.restore(frame(spark, ["EMAIL_18686338BC2AD87", "EMAIL_18686338BC2AD87A"]), vault)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) < 60 and [r.text for r in out.collect()] == ["a@b.co"] * 2
    paths = [t.stored_at for t in made]
    assert paths and all(Path(p.removeprefix("file:")).exists() for p in paths)
    for t in made:
        dropped(t)
    assert not any(Path(p.removeprefix("file:")).exists() for p in paths)


def test_restored_structures_have_a_small_plan(spark):
    vault = spark.createDataFrame([("EMAIL_18686338BC2AD87A", "a@b.co")], "token string, value string")
    rows = frame(spark, ["EMAIL_18686338BC2AD87A"]).select("id", F.struct(F.array("text").alias("notes")).alias("c"))
    out = structured.restore_structured(rows, vault, ["c"])
    assert len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 60 and out.first().c.notes == ["a@b.co"]


def test_policies(spark):
    with pytest.raises(ValueError):
        Policy("lenient")
    with pytest.raises(ValueError):
        Policy(kinds=frozenset({"CARD"}))
    df = frame(spark, ["a@b.co 0501234567"])
    assert tokens.anonymize(df, "text", "s", policy=Policy("audit"), which=CONTACT).first().text == "a@b.co 0501234567"
    assert tokens.anonymize(df, "text", "s", policy=Policy(kinds=frozenset({"EMAIL"})), which=CONTACT).first().text.endswith(" 0501234567")


def test_guards(spark):
    leaks = lambda s: spark.range(1).select(guard.leaks(F.lit(s)).alias("v")).first().v
    assert leaks("a@b​.co") and leaks("٠٥٠١٢٣٤٥٦٧") and leaks("4111 1111 1111 1111") and not leaks("EMAIL_18686338BC2AD87A fine")
    with pytest.raises(Exception, match="residual personal data"):
        guard.residual(frame(spark, ["a@b.co"]), strict=True, which=CONTACT).collect()


def test_second_pass_over_redacted_text(spark):
    rows = frame(spark, ["call 0501234567 now", "رقم ٠٥٠١٢٣٤٥٦٧", "PHONE_E49C965870629966 only", "PHONE_E49C965870629966 and 0501234567"])
    which = D.detectors("PHONE")
    left = {r.id: r.residual for r in guard.residual(tokens.anonymize(rows.where("id < 2"), "text", "s", "t", which=which).select("id", "text"), which=which).collect()}
    assert left == {0: 0, 1: 0}
    assert [r.residual for r in guard.residual(rows.where("id > 1"), which=which).orderBy("id").collect()] == [0, 1]


def test_keys_and_headers():
    assert structured.key_kind("customer_phone") == "PHONE" and structured.key_kind("total_phone") is None and structured.key_kind("telex") is None
    assert structured.key_kind("manager", False) is None and structured.key_kind("manager") == "PERSON"
    assert [structured.header_kind(h) for h in ("Email Address", "email status", "Mobile", "Home City", "First Name", "Company", "﻿Phone", "x.id", "Notes")] == ["EMAIL", None, "PHONE", "ADDRESS", "PERSON", "ORGANIZATION", "PHONE", None, None]
    assert structured.table_kinds(["Phone", "Mobile", "x"]) == {"PHONE": 2}


def office(kind, parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = office("DOCX", {"word/document.xml": '<w:p><w:tab/><w:t xml:space="preserve">a &amp; b@c.co</w:t><w:t/><w:t></w:t><w:t>0501234567</w:t></w:p>'})
XLSX = office("XLSX", {"xl/worksheets/sheet1.xml": "<c><is><t>inline</t></is></c>", "xl/sharedStrings.xml": "<si><t>x@y.co</t></si><si><t>two</t></si>"})
HTML = b'<!DOCTYPE html><p title="a>b">Call 0501234567</p><script>var a="<b@c.co>";</script><!-- x@y.co --><b>&amp; ok</b>tail'
FILES = {"TXT": b"mail a@b.co", "CSV": b'name,phone\n"A, B",0501234567\nx,\n', "JSON": b'{"b": ["x@y.co", 1], "a/b": "t", "n": null}', "HTML": HTML, "DOCX": DOCX, "XLSX": XLSX}


@pytest.mark.parametrize("kind", FILES)
def test_formats_put_back_what_they_read(kind):
    body, segments = formats.extract_text(FILES[kind], kind)
    assert all(0 <= a <= b <= len(body) for a, b, _ in segments)
    back = formats.emit_bytes(FILES[kind], kind, body)
    if kind in ("DOCX", "XLSX"):
        assert formats.extract_text(back, kind) == (body, segments)
    elif kind == "JSON":
        assert json.loads(back) == json.loads(FILES[kind])
    else:
        assert back == FILES[kind]


def test_format_pieces_and_errors():
    assert [b for _, b in formats.leaves_of(HTML, "HTML")[0]] == ["Call 0501234567", "&amp; ok", "tail"]
    assert [b for _, b in formats.leaves_of(DOCX, "DOCX")[0]] == ["a & b@c.co", "0501234567"]
    assert [b for _, b in formats.leaves_of(XLSX, "XLSX")[0]] == ["x@y.co", "two", "inline"]
    assert [p for p, _ in formats.leaves_of(FILES["JSON"], "JSON")[0]] == ["/a~1b", "/b/0"]
    with pytest.raises(formats.DocumentError):
        formats.emit_bytes(HTML, "HTML", "one piece")
    with pytest.raises(formats.DocumentError):
        formats.extract_text(b"%PDF-", "PDF")


def test_folder_jobs(spark, tmp_path):
    for kind, data in FILES.items():
        (tmp_path / f"f.{kind.lower()}").write_bytes(data)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "bare").write_bytes(b"\x0b{}")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in formats.read_documents(spark, str(tmp_path)).collect()}
    assert kinds == {"f.txt": "TXT", "f.csv": "CSV", "f.json": "JSON", "f.html": "HTML", "f.docx": "DOCX", "f.xlsx": "XLSX", "bad.docx": "DOCX", "bare": "TXT"}
    (tmp_path / "k.json").write_bytes('{"customer_name": "Ali", "cr_number": "1010123456", "amount": "call 0501234567", "list": {"iban": ["x", "EMAIL_18686338BC2AD87A"]}, "n": 1.5}'.encode())
    manifest, vault = batch.redact_folder(spark, str(tmp_path), str(tmp_path / "out"), "s", "t", which=CONTACT, tables=True)
    assert {r.value for r in vault.collect()} == {"a@b.co", "0501234567", "x@y.co", "b@c.co", "Ali", "1010123456", "x", "A, B"}
    out = {}
    for r in manifest.collect():
        body = (tmp_path / "out" / r.output).read_bytes()
        assert len(body) == r.size and r.output.startswith(r.path_hash + ".")
        out.setdefault(r.output.rsplit(".", 1)[1], []).append((r.total, body))
    assert sum(map(len, out.values())) == 8 and len(list((tmp_path / "out").iterdir())) == 8
    table = list(csv.reader(io.StringIO(out["csv"][0][1].decode())))
    assert table[0] == ["name", "phone"] and table[1][0].startswith("PERSON_") and table[1][1].startswith("PHONE_") and table[2][0].startswith("PERSON_") and table[2][1] == ""
    assert b"0501234567" not in out["html"][0][1] and b"&amp; ok" in out["html"][0][1]
    keyed = next(json.loads(b) for n, b in out["json"] if n == 4)
    assert keyed["customer_name"].startswith("PERSON_") and keyed["cr_number"].startswith("CR_") and keyed["amount"].startswith("call PHONE_") and keyed["list"]["iban"][0].startswith("IBAN_") and keyed["list"]["iban"][1] == "EMAIL_18686338BC2AD87A" and keyed["n"] == 1.5
    redacted = formats.read_documents(spark, str(tmp_path / "out"))
    again = {r.kind + str(len(r.restored)): bytes(r.restored) for r in batch.restore_documents(redacted, vault).where("error is null").collect()}
    assert b"Ali" in b"".join(again.values()) and HTML in again.values() and b"A, B" in b"".join(again.values())
    found_json = batch.detections_json("d")
    line = D.detect(frame(spark, ["a@b.co"]), out="d", which=CONTACT).select(found_json.alias("j")).first().j
    assert json.loads(line) == [{"kind": "EMAIL", "start": 0, "end": 6, "text": "a@b.co", "confidence": 0.99, "source": "regex.email"}]
    batch.write_jsonl(manifest, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 8
    summaries, found_rows = batch.scan_folder(spark, str(tmp_path), ["txt"], which=CONTACT)
    assert sorted(r.total for r in summaries.collect())[-1] == 1 and found_rows.count() == 1 and batch.top_files(summaries, "path_hash").count() == 1


def test_bodies(spark):
    request = {
        "model": "m0501234567", "system": [{"type": "text", "text": "a@b.co", "id": "x@y.co"}], "input": "call 0501234567",
        "messages": [
            {"role": "x@y.co", "content": "mail a@b.co"}, {"content": {"type": "x@y.co", "input": {"k": ["a@b.co", {"x@y.co": "a@b.co"}]}}}, "x@y.co",
            {"content": [{"text": "a@b.co", "content": ["a@b.co"], "input": "x@y.co"}], "tool_calls": [{"function": {"name": "x@y.co", "arguments": "a@b.co"}}, {"function": "x@y.co"}]},
        ],
    }
    df = spark.createDataFrame([(1, json.dumps(request)), (2, "[1"), (3, None), (4, '"a@b.co"')], "id int, body string")
    got = {r.id: r for r in bodies.redact_bodies(df, "body", "request", "s", "t", which=CONTACT).collect()}
    token = re.search("EMAIL_[A-F0-9]{16}", got[1].body)[0]
    phone = re.search("PHONE_[A-F0-9]{16}", got[1].body)[0]
    want = json.loads(json.dumps(request).replace("a@b.co", token).replace("call 0501234567", "call " + phone))
    assert json.loads(got[1].body) == want and len(got[1].records) == 2 and len(got[1].detections) == 8
    assert got[2].body is None and got[2].error.startswith("JSONDecodeError") and got[3].body is None and got[3].error is None and got[4].body == '"a@b.co"'
    vault = spark.createDataFrame([r.asDict() for r in got[1].records])
    back = bodies.restore_bodies(spark.createDataFrame([(1, got[1].body), (2, json.dumps({token: [token, "x " + phone + "!", 5]})), (2, None)], "id int, body string"), "body", vault).collect()
    assert json.loads(back[0].body) == request or json.loads(back[1].body) == request
    assert {token: ["a@b.co", "x 0501234567!", 5]} in [json.loads(r.body) for r in back if r.body]


def test_hook_payloads(spark):
    vault = spark.createDataFrame([(TOKEN, "a@b.co")], "token string, value string")
    rows = [(1, "PreToolUse", "Write", json.dumps({"file": TOKEN, "n": 1})), (2, "PreToolUse", "Edit", '{"file": "a@b.co"}'), (3, "PostToolUse", "Bash", '["a@b.co", {"k": "a@b.co"}]'), (4, "PostToolUse", "Bash", "see a@b.co"), (5, "UserPromptSubmit", "", "a@b.co"), (6, "PreToolUse", "Bash", '{"x": "a@b.co 0501234567"}'), (7, "PostToolUse", "Bash", None), (8, "PreToolUse", "Write", f"say {TOKEN}")]
    df = spark.createDataFrame(rows, "id int, event string, tool string, payload string")
    got = {r.id: r for r in guard.hook_decision(df, secret="s", tenant="t", vault=vault, which=CONTACT).collect()}
    assert [got[i].decision for i in range(1, 9)] == ["restore", None, "replace", "replace", "block", "deny", None, "restore"]
    assert json.loads(got[1].new_payload) == {"file": "a@b.co", "n": 1} and got[8].new_payload == "say a@b.co"
    token = got[4].new_payload.removeprefix("see ")
    assert re.fullmatch("EMAIL_[A-F0-9]{16}", token) and json.loads(got[3].new_payload) == [token, {"k": token}] and got[3].summary == "EMAIL:2" and got[6].summary == "EMAIL:1, PHONE:1"
    assert [got[i].new_payload for i in (2, 5, 6, 7)] == [None] * 4


def test_restore_keeps_rows_apart(spark):
    vault = spark.createDataFrame([(TOKEN, "x@y.z")], "token string, value string")
    rows = [(1, f"a {TOKEN} b"), (1, f"c {TOKEN}{TOKEN} d"), (None, f"n {TOKEN}"), (None, None), (2, ""), (3, f"\ue000 {TOKEN} \ue001"), (1, f"a {TOKEN} b")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted(((r.id, r.text, r.restored) for r in restore.restore(df, vault).collect()), key=str)
    assert got == sorted(((i, t and t.replace(TOKEN, "x@y.z"), [TOKEN] if t and TOKEN in t else []) for i, t in rows), key=str)
    with pytest.raises(ValueError):
        restore.restore(df.withColumn("restored", F.lit(1)), vault)
    with pytest.raises(ValueError):
        tokens.anonymize(df.withColumn("records", F.lit(1)), "text", "s")


def test_longest_needle_first(spark):
    pairs = [("ab", "1"), ("abc", "2"), ("", "x"), ("zz", "3"), ("2", "ab")]
    column = F.array(*[F.struct(F.lit(a).alias("needle"), F.lit(b).alias("value")) for a, b in pairs])
    r = spark.range(1).select(tokens.replace_longest_first(F.lit("ab abc abab"), column).alias("r")).first().r
    assert r.text == "1 ab 11" and [(h.needle, h.n) for h in r.hits] == [("abc", 1), ("ab", 3), ("2", 1)]


def test_views_of_stable_texts(spark):
    texts = ["plain", "جوال ٠٥٠١٢٣٤٥٦٧ من أحمد، ۱۲۳", "مُحمد ٠٥", "ｆull ½", "日本 Ünder ß", "ﷺ", "", None]
    df = frame(spark, texts).withColumn("v", text.unstable_views(F.array("text"))).withColumn("s", text.is_stable(F.col("text"))).withColumn("f", text.stable_view(F.col("text")))
    for r in df.collect():
        if r.text is None:
            continue
        form, src = text._folded_form(r.text)
        if r.s:
            assert r.v is None and form == r.f and src == list(range(len(r.text)))
        else:
            assert (r.v[0].text, r.v[0].src) == (form, src)
    assert [r.s for r in df.orderBy("id").collect()][:7] == [True, True, False, False, True, False, True]


def test_a_transcript_is_followed(spark, tmp_path):
    spark.dataSource.register(side.TranscriptTail)
    say = lambda t: json.dumps({"type": "assistant", "timestamp": "t", "message": {"content": [{"type": "text", "text": t}]}}) + "\n"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(say("old"))
    vault = spark.createDataFrame([(TOKEN, "a@b.co")], "token string, value string")
    got = []
    lines = spark.readStream.format("transcript_tail").option("path", str(folder)).load()
    query = events.follow(side.assistant_messages(lines), lambda: vault, lambda b, n: got.extend(r.text for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 90
        time.sleep(3)
        with open(folder / "a.jsonl", "a") as f:
            f.write(say(f"new {TOKEN}") + say("cut")[:20])
        while got != ["new a@b.co"] and time.time() < until:
            time.sleep(0.5)
        assert got == ["new a@b.co"]
    finally:
        query.stop()
    reader = side.TailReader(str(folder), "start")
    rows, stop = reader.read(reader.initialOffset())
    assert len(list(rows)) == 2 and stop["at"] < (folder / "a.jsonl").stat().st_size and len(list(reader.readBetweenOffsets({"path": str(folder / "a.jsonl"), "at": 0}, stop))) == 2


def test_gold(spark, tmp_path):
    for name in ("first", "second"):
        (tmp_path / name).mkdir()
    (tmp_path / "first" / "a.txt").write_text("é mail a@b.co")
    (tmp_path / "second" / "a.txt").write_text("other")
    (tmp_path / "second" / "b.txt").write_text("é")
    rows = [{"file": "a.txt", "start": 8, "end": 14, "kind": "EMAIL"}, {"file": "a.txt", "start": 0, "end": 2, "kind": "CARD"}, {"file": "b.txt", "start": 1, "end": 2, "kind": "EMAIL"}, {"file": "none.txt", "start": 0, "end": 1, "kind": "EMAIL"}]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spans, texts, counts = side.read_gold(spark, str(tmp_path / "gold.jsonl"), str(tmp_path / "first"), str(tmp_path / "second"))
    assert [tuple(r) for r in spans.collect()] == [("a.txt", 7, 13, "EMAIL")] and texts.count() == 2 and tuple(counts.first()) == (2, 1, 1)


def sse(v):
    return "data: " + json.dumps(v, separators=(",", ":"))




def delta(text, kind="text_delta", name="text"):
    return sse({"type": "content_block_delta", "index": 0, "delta": {"type": kind, name: text}})


MARKED = f"\ue000{TOKEN}\ue001"


def test_recut_shapes():
    r = events.Recutter()
    assert r.block(delta("see " + TOKEN[:9])) == delta("see ") and r.blocks(sse({"type": "message_stop"}))[0] == delta(TOKEN[:9])
    r = events.Recutter()
    r.block(delta(TOKEN[:9]))
    assert json.loads(events.Recutter(r.state()).block(delta(TOKEN[9:] + " x"))[6:])["delta"]["text"] == MARKED + " x"
    assert r.block(delta(TOKEN, "signature_delta", "signature")) == delta(TOKEN, "signature_delta", "signature")
    chat = lambda d: sse({"choices": [{"index": 0, "delta": d}]})
    r = events.Recutter()
    r.block(chat({"tool_calls": [{"index": 3, "function": {"arguments": TOKEN[:8]}}]}))
    r.block(chat({"content": TOKEN}))
    last = [json.loads(b[6:])["choices"][0]["delta"] for b in r.blocks("data: [DONE]")[:-1]]
    assert {"content": MARKED} in last and {"tool_calls": [{"index": 3, "function": {"arguments": TOKEN[:8]}}]} in last
    r = events.Recutter()
    r.block(sse({"type": "response.output_text.delta", "item_id": "i", "delta": TOKEN}))
    assert r.rests() == [] and json.loads(r.block(sse({"type": "response.completed", "response": {"text": [TOKEN], TOKEN: 1}}))[6:])["response"] == {"text": [MARKED], TOKEN: 1}
    assert r.block("event: x\ndata: not json ") == "event: x\ndata: not json " and r.rests() == []
    assert [events.whole(v, 7) for v in (3, True, "3", 3.0, None)] == [3, 7, 7, 7, 7]


def test_streams_survive_any_cut(spark, tmp_path):
    whole = f"to {TOKEN}, {TOKEN} and EMAIL_0000000000000000"
    vault = spark.createDataFrame(list(VAULT.items()), "token string, value string")
    rows = []
    for size in (1, 5, 22):
        parts = [whole[i : i + size] for i in range(0, len(whole), size)]
        rows += [(str(size), i, delta(p)) for i, p in enumerate(parts)] + [(str(size), len(parts), sse({"type": "message_stop"}))]
    schema = "stream_id string, seq long, block string"
    df = spark.createDataFrame(rows[::-1], schema)

    def joined(got):
        out = {}
        for r in sorted(got, key=lambda r: (r.stream_id, r.seq, r.part)):
            out[r.stream_id] = out.get(r.stream_id, "") + json.loads(r.block[6:]).get("delta", {}).get("text", "")
        return out

    want = dict.fromkeys(("1", "5", "22"), whole.replace(TOKEN, "a@b.co"))
    assert joined(events.restore_batch(df, vault).collect()) == want
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    reads, rows = [], []

    def read():
        reads.append(1)
        return vault

    query = events.restore_stream(stream, read, lambda batch, n: rows.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:  # timeouts make the query go on without data, so the result is awaited, not the query
        until = time.time() + 90
        while (got := joined(rows)) != want and time.time() < until:
            time.sleep(0.5)
        assert got == want and len(reads) > 1
    finally:
        query.stop()


def test_many_short_streams_take_no_call_each(spark):
    """5,000 streams of three events, ids and rests apart; a stream without an id is one too."""
    rows = [(None if k == 7 else str(k), i, delta(p)) for k in range(5_000) for i, p in enumerate((f"{k} ", TOKEN[:9], TOKEN[9:]))]
    df = spark.createDataFrame(rows[::-1], "stream_id string, seq long, block string").coalesce(1)
    calls = [x for x in ("FlatMapGroupsInPandas", "FlatMapGroupsInArrow") if x in events.recut_batch(df)._jdf.queryExecution().optimizedPlan().toString()]
    got = {}
    for r in sorted(events.recut_batch(df).collect(), key=lambda r: (r.stream_id or "", r.seq, r.part)):
        got.setdefault(r.stream_id, []).append(json.loads(r.block[6:])["delta"]["text"])
    assert got == {(None if k == 7 else str(k)): [f"{k} ", "", "", TOKEN.join(("\ue000", "\ue001"))] for k in range(5_000)} and calls == []
    assert events.recut_batch(df.limit(0)).collect() == []


def test_stream_shapes_is_dealt_out_and_joined_once(spark, monkeypatch):
    """A small table's one partition is not all that works; a block without a mark is not joined, and without heavy keys one join does."""
    given = {}
    monkeypatch.setattr(folder_queries, "stored", lambda df, name: given.setdefault(name, df) and stored(df, name))
    rows = catalog.QUERIES["stream_shapes"](spark, SF).count()
    assert rows == 3 * spark.read.parquet(f"{SF}/customer.parquet").count() and given["tokens"].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    vault = spark.createDataFrame(list(VAULT.items()), "token string, value string")
    for n, joins in ((200, 1), (300, 3)):
        blocks = stored(spark.createDataFrame([("s", i, 0, f"{MARKED} {i}") for i in range(n)] + [("s", n, 0, "plain")], "stream_id string, seq long, part int, block string"), "blocks")
        out = events.put_values(blocks, vault)
        assert sorted(r.block for r in out.collect()) == sorted([f"a@b.co {i}" for i in range(n)] + ["plain"])
        assert len(re.findall(r"Join (?:Inner|LeftOuter)", out._jdf.queryExecution().optimizedPlan().toString())) <= joins


def test_lines_without_a_text_are_written_once(spark, monkeypatch):
    """What is remembered of a line is the same in every stream; lines with texts are not remembered."""
    silent = {'data: {"usage": 1}': 'data: {"usage":1}', "data:  [1]": "data:  [1]", "event: \ue000": "event: \ue0020", 'data:{"a": "\\ue000"} ': 'data:{"a":"\ue0020"}', "data: {x": "data: {x"}
    asked = []
    monkeypatch.setattr(events.Recutter, "event", lambda self, e, f=events.Recutter.event: asked.append(e) or f(self, e))
    monkeypatch.setattr(events, "_silent", {})
    for _ in range(3):
        assert [events.Recutter().block(k) for k in silent] == list(silent.values())
    assert len(asked) == 2
    r = events.Recutter()
    assert [json.loads(r.block(delta(TOKEN + " "))[6:])["delta"]["text"] for _ in range(2)] == [MARKED + " "] * 2
    last = sse({"type": "response.completed", "response": {"text": TOKEN}})
    assert [MARKED in r.block(last) for _ in range(2)] == [True] * 2 and set(events._silent) == set(silent)


def test_a_failing_stream_gives_no_result(spark, monkeypatch):
    """Neither a failed batch nor a slow one may look like a result."""
    put = events.put_values

    def broken(*args, **options):
        raise RuntimeError("no vault")

    monkeypatch.setattr(events, "put_values", broken)
    with pytest.raises(Exception, match="no vault"):
        catalog.QUERIES["live_restore"](spark, SF)

    def slow(*args, **options):
        ticks.append(400)
        return put(*args, **options)

    ticks, now = [], time.time
    monkeypatch.setattr(events, "put_values", slow)
    monkeypatch.setattr(time, "time", lambda: now() + sum(ticks))  # six minutes pass in the batch
    assert catalog.QUERIES["live_restore"](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_ends_of_streams():
    ends = ["data: [DONE]", 'event: x\ndata:{"type":"message_stop"}', 'data: {"type": "response\\u002ecompleted"}']
    assert [events.ends(b) for b in (*ends, "data: [DONE] ", 'data: {"t":"message_stop"}', delta("x"), "")] == [True] * 3 + [False] * 4


def test_a_stream_with_a_gap_gives_all_it_has(spark, tmp_path):
    schema = "stream_id string, seq long, block string"
    spark.createDataFrame([("g", 0, delta("a ")), ("g", 2, delta("c " + TOKEN)), ("g", 3, delta("d "))], schema).write.parquet(str(tmp_path / "in"))
    rows = []
    query = events.recut_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "2 seconds").writeStream.outputMode("append").foreachBatch(lambda b, n: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 60
        while len(rows) < 3 and time.time() < until:
            time.sleep(0.5)
        time.sleep(1)
        assert [(r.seq, json.loads(r.block[6:])["delta"]["text"]) for r in sorted(rows, key=lambda r: (r.seq, r.part))] == [(0, "a "), (2, "c "), (3, MARKED + "d ")]
    finally:
        query.stop()


def test_values_are_escaped_and_marks_of_the_stream_stay(spark):
    vault = spark.createDataFrame([(TOKEN, 'a"b\\c\n\ue0021'), ("PHONE_D9E4E10C9DD1E02E", "1")], "token string, value string")
    odd = "\ue000x\ue001 \ue0021"
    blocks = [delta(f"{odd} {TOKEN[:-1]} "), "event: " + odd, sse({"type": "response.completed", "response": {"t": TOKEN}}), "data: \ue002 no json"]
    df = spark.createDataFrame([("s", i, b) for i, b in enumerate(blocks)], "stream_id string, seq long, block string")
    got = [r.block for r in events.restore_batch(df, vault).orderBy("seq", "part").collect()]
    assert json.loads(got[0][6:])["delta"]["text"] == f'{odd} a"b\\c\n\ue0021 ' and got[1] == blocks[1] and got[3] == blocks[3]
    assert json.loads(got[2][6:])["response"]["t"] == 'a"b\\c\n\ue0021'
    raw = spark.createDataFrame([("s", "a\n\nb\u2028c\n\nd")], "stream_id string, raw string")
    assert [(r.seq, r.block) for r in events.event_blocks(raw).orderBy("seq").collect()] == [(0, "a"), (1, "b\u2028c"), (2, "d")]


def test_scores(spark):
    d = spark.createDataFrame([("f", 0, 5, "EMAIL", "s"), ("f", 10, 12, "EMAIL", "s"), ("f", 0, 5, "PHONE", "s")], "file string, start int, end int, kind string, source string")
    g = spark.createDataFrame([("f", 3, 8, "EMAIL"), ("f", 20, 22, "EMAIL")], "file string, start int, end int, kind string")
    got = {r.kind: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.scores(evaluate.outcomes(d, g, "file"), "kind").collect()}
    assert got == {"EMAIL": (1, 1, 1, 0.5, 0.5), "PHONE": (0, 1, 0, 0.0, 0.0)}


def test_model_spans(spark):
    t = "Khalid bin Sultan met Acme"
    words = [(0, 6, "B-PER", 0.99), (7, 10, "O", 0.9), (11, 17, "B-PERS", 0.8), (18, 21, "O", 1.0), (22, 26, "I-ORG", 0.9)]
    assert [x[:3] for x in ner.islands(words, t)] == [(0, 17, "PERSON"), (22, 26, "ORGANIZATION")] and ner.islands([], t) == []
    assert ner.fold_pieces([("Kha", 0, 3, "O", 0.9), ("##lid", 3, 6, "B-PER", 0.7), ("##x", 6, 7, "I-PER", 0.6)]) == [(0, 7, "B-PER", 0.7)]
    assert ner.windows(1001) == [(0, 500), (500, 1000), (1000, 1001)] and ner.label_parts("S-GPE") == ("B", "ADDRESS") and ner.label_parts("X") == ("O", "")
    assert ner.reconcile([(0, 4, "ORGANIZATION", 0.9), (10, 12, "PERSON", 0.9)], [(2, 6, "PERSON", 0.9), (9, 14, "PERSON", 0.95)]) == [(0, 4, "ORGANIZATION", 0.9), (9, 14, "PERSON", 0.95)]


def plain_runs(words, text):
    """One word at a time: a run is open or not, and a name may be waiting behind connectives."""
    runs, linked = [], False
    still = False
    for start, end, label, p in words:
        tag, kind = ner.label_parts(label)
        if still and runs[-1][2] == "PERSON" and text[start:end].lower() in fixed.CONNECTIVES:
            runs[-1][1], linked = end, True
            continue
        if tag == "O":
            still = False
        elif still and kind == runs[-1][2] and (tag == "I" or linked):
            runs[-1][1] = end
            runs[-1][3].append(p)
        else:
            runs.append([start, end, kind, [p]])
            still = True
        linked = False
    return [(a, b, k, round(sum(p) / len(p), 6)) for a, b, k, p in runs if sum(p) / len(p) >= 0.5 and k in fixed.KINDS]


def test_entity_runs_in_three_forms(spark):
    rnd = random.Random(3)
    rows, want, texts = [], {}, {}
    for doc in range(60):
        words = [(rnd.choice(["bin", "ibn", "Ali", "x"]), rnd.choice(["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "E-LOC", "S-PER", "B-MISC"]), rnd.choice([0.25, 0.5, 1.0])) for _ in range(rnd.randrange(1, 14))]
        text = texts[doc] = " ".join(w for w, _, _ in words)
        at, spans = 0, []
        for i, (w, label, p) in enumerate(words):
            spans.append((at, at + len(w), label, p))
            rows.append((doc, i, at, at + len(w), label, p, w))
            at += len(w) + 1
        want[doc] = plain_runs(spans, text)
        assert [(a, b, k, round(p, 6)) for a, b, k, p in ner.islands(spans, text, 0.5)] == want[doc]
    got = {}
    for r in ner.entity_runs(spark.createDataFrame(rows, "doc int, i int, start int, end int, label string, p double, surface string"), "doc", 0.5).orderBy("doc", "start").collect():
        got.setdefault(r.doc, []).append((r.start, r.end, r.kind, round(r.p, 6)))
    assert got == {k: v for k, v in want.items() if v}


def test_runs_of_many_texts_take_no_table_each():
    words = [(0, 6, "B-PER", 0.99), (7, 10, "O", 0.9), (11, 17, "B-PER", 0.8)]
    began = time.process_time()
    assert all([x[:3] for x in ner.islands(words, "Khalid bin Sultan")] == [(0, 17, "PERSON")] for _ in range(5_000))
    assert time.process_time() - began < 2


def test_vault_file_and_side_inputs(spark, tmp_path):
    rows = [("EMAIL", "EMAIL_1", "á@b.co", "á@b.co"), ("OLD", "OLD_1", "x", "x")]
    vault = spark.createDataFrame(rows, "kind string, token string, value string, normalized string")
    side.save_vault(vault, str(tmp_path / "v"), "k")
    assert [tuple(r) for r in side.load_vault(spark, str(tmp_path / "v"), "k").collect()] == rows[:1]
    assert side.load_vault(spark, str(tmp_path / "none"), "k").count() == 0
    with pytest.raises(Exception):
        side.load_vault(spark, str(tmp_path / "v"), "wrong")
    lines = spark.createDataFrame([(json.dumps({"type": "assistant", "timestamp": "t", "message": {"content": [{"type": "text", "text": "a"}, {"type": "thinking", "thinking": "b"}]}}),), ('{"type":"user"}',), ("broken",)], "value string")
    assert [r.text for r in side.assistant_messages(lines).collect()] == ["a"] and side.assistant_messages(lines, thinking=True).count() == 2


def test_a_vault_file_passes_through_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(side, "_ROWS", 700)
    rows = [("EMAIL", f"EMAIL_{i:05}", f"\u00e1{i}@b.co \"]}} \\" * 90, None) for i in range(2_000)]
    vault = spark.createDataFrame(rows, "kind string, token string, value string, normalized string")
    path, sizes = tmp_path / "v", []
    pieces = side._pieces
    monkeypatch.setattr(side, "_pieces", lambda parts, *size: (sizes.append(len(p)) or p for p in pieces(parts, *size)))
    side.save_vault(vault, str(path), "k")
    assert sorted(tuple(r) for r in side.load_vault(spark, str(path), "k").collect()) == rows
    assert max(sizes) == side._PIECE and path.stat().st_size > 4 * side._PIECE
    box = json.loads(path.read_text())
    from base64 import b64decode, b64encode
    from hashlib import sha256

    jvm = spark.sparkContext._jvm  # the whole file is one message of the cipher
    cipher = jvm.javax.crypto.Cipher.getInstance("ChaCha20-Poly1305")
    cipher.init(2, jvm.javax.crypto.spec.SecretKeySpec(sha256(b"k").digest(), "ChaCha20"), jvm.javax.crypto.spec.IvParameterSpec(b64decode(box["nonce"])))
    told = json.loads(bytes(cipher.doFinal(b64decode(box["ciphertext"]))))["records"]
    assert [tuple(r.values()) for r in told] == rows
    path.write_text(json.dumps(dict(reversed(box.items()))))
    assert side.load_vault(spark, str(path), "k").count() == 2_000
    body = bytearray(b64decode(box["ciphertext"]))
    body[1_000_000] ^= 1
    path.write_text(json.dumps(box | {"ciphertext": b64encode(body).decode()}))
    with pytest.raises(ValueError, match="changed"):
        side.load_vault(spark, str(path), "k")


def test_the_rest_does_not_import_the_training_operators():
    root = Path(__file__).resolve().parents[1] / "veilframe"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "veilframe.llm" not in f.read_text() and "from .llm" not in f.read_text() and "from ..llm" not in f.read_text()
