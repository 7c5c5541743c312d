"""The registered queries: each applies one operator or a short chain of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import checks, text
from ..model import Policy
from ..operators import detect as D
from ..operators import guard, ner, restore, structured, tokens
from ..session import stored
from ..sources import formats
from ..streaming import events
from . import batch, evaluate
from .carriers import carrier

SECRET, TENANT = "query-secret", "tenant-a"
CONTACT = D.detectors("EMAIL", "PHONE")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _found(spark, sf_dir, name, *kinds, **options) -> DataFrame:
    return D.detect_rows(carrier(spark, sf_dir, name), "id", which=D.detectors(*kinds), **options)


def _spans(spark, sf_dir, name, *kinds) -> DataFrame:
    return _found(spark, sf_dir, name, *kinds).select("id", "start", "end", "kind", "text", "source")


def _anonymized(spark, sf_dir, **options) -> DataFrame:
    return tokens.anonymize(carrier(spark, sf_dir, "contact"), "text", SECRET, TENANT, which=CONTACT, **options)


def email_spans(spark, sf_dir):
    return D.detect_rows(_table(spark, sf_dir, "documents"), "doc_id", which=D.detectors("EMAIL")).select("doc_id", "text")


def email_domains(spark, sf_dir):
    found = D.detect_rows(_table(spark, sf_dir, "documents"), "doc_id", which=D.detectors("EMAIL"))
    return found.groupBy(F.lower(F.substring_index("text", "@", -1)).alias("domain")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def digit_functions(spark, sf_dir):
    t = F.col("text")
    return carrier(spark, sf_dir, "folded").select("id", text.fold_digits(t).alias("folded"), text.digits_only(t).alias("digits"), text.alnum_upper(t).alias("alnum"))


def scrub_invisible(spark, sf_dir):
    return carrier(spark, sf_dir, "hidden").select("id", text.scrub(F.col("text")).alias("clean"))


def luhn_numbers(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]{2,})"), F.lit(1))).alias("digits"))
    return docs.select("doc_id", "digits", checks.luhn(F.col("digits")).alias("valid"))


def iban_remainders(spark, sf_dir):
    iban = F.regexp_extract("text", "(SA[0-9]{22})", 1)
    return carrier(spark, sf_dir, "account").select("id", checks.mod97(F.concat(F.substring(iban, 5, 20), F.substring(iban, 1, 4))).cast("int").alias("remainder"), checks.valid_iban(iban).alias("valid"))


def kuwait_ids(spark, sf_dir):
    digits = F.expr("concat('2', lpad(CAST(s_suppkey * 8191 % 10000000000 AS STRING), 10, '0'), CAST(s_suppkey % 10 AS STRING))")
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), checks.kuwait_mod11(digits).alias("valid"))


def path_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.path_hash(F.col("url")).alias("path_hash"), text.pointer_escape(F.col("url")).alias("pointer"), text.folder_name(F.col("url")).alias("folder"))


def title_variants(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", text.title_variant(F.lower("n_name")).alias("titled"), text.should_augment(F.lower("n_name")).alias("augment"), text.safe_split(F.concat(F.lit("x "), F.col("n_name"))).cast("int").alias("safe"))


def arabic_normal_forms(spark, sf_dir):
    word = F.concat(F.lit("  الإِدَارَة  "), F.translate(F.col("n_nationkey").cast("string"), "0123456789", fixed.ARABIC_INDIC), F.lit(" مـؤسسة "))
    return _table(spark, sf_dir, "nation").select("n_nationkey", text.normalize_arabic(word).alias("normal"), text.reverse_arabic_runs(F.concat(F.lit("a باج "), F.col("n_name"))).alias("turned"), text.strip_particles(F.lit("والكتاب")).alias("stem"))


def format_kinds(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return pages.select("page_id", formats.sniff(F.col("content")).alias("kind"))


def html_text(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", formats.extracting()(F.encode("html", "UTF-8"), F.lit("HTML")).alias("x"))
    return pages.select("page_id", F.posexplode("x.segments").alias("node", "s"), F.col("x.text").alias("text")).select("page_id", "node", F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


def html_redacted(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"), F.lit("HTML").alias("kind"))
    done = batch.redact_documents(pages, SECRET, TENANT, which=CONTACT)
    return done.select(F.col("path").cast("long").alias("page_id"), F.sha2("redacted", 256).alias("sha256"), F.size("detections").alias("n"), "error")


def geo_gated(spark, sf_dir):
    places = D.Gazetteer(["Riyadh", "Jeddah", "United Arab Emirates", "X"])
    return D.detect_rows(carrier(spark, sf_dir, "place"), "id", which=(), gazetteer=places).select("id", "start", "end", "kind", "text", "source")


def resolve_overlaps(spark, sf_dir):
    return _spans(spark, sf_dir, "company", "COMMERCIAL_REGISTRATION", "TAX_NUMBER", "PHONE")


def context_boost(spark, sf_dir):
    found = _found(spark, sf_dir, "contact", "EMAIL", "PHONE")
    return found.select("id", "start", "kind", F.round("confidence", 4).alias("confidence"), F.array_join("matched_terms", ",").alias("terms"))


def suppressed(spark, sf_dir):
    phrases = D.Suppressor.from_text("# phrases\nEMAIL:c1@mail.example.ae\nNOTHING:x\nc2@mail.example.ae\nPHONE:c3@mail.example.ae")
    return _found(spark, sf_dir, "contact", "EMAIL", suppressor=phrases).select("id", "text")


def tokenized(spark, sf_dir):
    email = F.concat(F.lit("  C"), F.col("c_custkey").cast("string"), F.lit("@Mail.example.ae "))
    t = _table(spark, sf_dir, "customer")
    return t.select(F.col("c_custkey").alias("id"), tokens.token_for("EMAIL", email, SECRET, TENANT).alias("email_token"), tokens.token_for("PHONE", F.concat(F.lit("05"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), SECRET, TENANT, "s1").alias("phone_token"))


def anonymize_text(spark, sf_dir):
    return _anonymized(spark, sf_dir).select("id", "text", F.size("detections").alias("n"))


def vault_records(spark, sf_dir):
    return tokens.vault(_anonymized(spark, sf_dir), "id")


def anonymize_hidden(spark, sf_dir):
    return tokens.anonymize(carrier(spark, sf_dir, "hidden"), "text", SECRET, TENANT, which=CONTACT).select("id", "text")


def anonymize_folded(spark, sf_dir):
    return tokens.anonymize(carrier(spark, sf_dir, "folded"), "text", SECRET, TENANT, which=CONTACT).select("id", "text")


def policy_balanced(spark, sf_dir):
    policy = Policy("balanced", allow=("C1@Mail.example.ae", "c2 mail example AE"))
    return _anonymized(spark, sf_dir, policy=policy).select("id", "text")


def policy_kinds(spark, sf_dir):
    return _anonymized(spark, sf_dir, policy=Policy(kinds=frozenset({"PHONE"}))).select("id", "text", F.size("detections").alias("n"))


def policy_audit(spark, sf_dir):
    return _anonymized(spark, sf_dir, policy=Policy("audit")).select("id", "text", F.size("records").alias("records"))


def _round_trip(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    done = stored(_anonymized(spark, sf_dir).select("id", "text", "records"), "anonymized")
    return done, stored(tokens.vault(done, "id"), "vault")


def restore_exact(spark, sf_dir):
    done, vault = _round_trip(spark, sf_dir)
    return restore.restore(done.select("id", "text"), vault, fuzzy=False).select("id", "text", F.size("restored").alias("restored"))


def restore_fuzzy(spark, sf_dir):
    done, vault = _round_trip(spark, sf_dir)
    # the last digit of every token is lost
    torn = done.select("id", F.regexp_replace("text", "(EMAIL_[A-F0-9]{15})[A-F0-9]", "$1").alias("text"))
    return restore.restore(torn, vault).select("id", "text", F.size("unrestored").alias("unrestored"))


def leak_gate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", guard.leaks(F.col("text")).alias("leaks"))


def residual_guard(spark, sf_dir):
    done = _anonymized(spark, sf_dir).select("id", "text")
    return guard.residual(done, which=CONTACT).select("id", "residual")


def structured_keys(spark, sf_dir):
    keys = spark.createDataFrame([(k,) for k in ("customer_name", "max_tokens", "phone", "tax_amount", "billing-email", "supplier.id", "رقم الجوال", "note", "tin")], "key string")
    return keys.select("key", structured.key_kind_column(F.col("key"), F.lit("abc")).alias("kind"))


def structured_redact(spark, sf_dir):
    rows = carrier(spark, sf_dir, "contact").select("id", F.struct(F.concat(F.lit("05"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("phone"), F.lit("0501234567").alias("amount_note"), F.array(F.concat(F.lit("mail c"), F.col("id").cast("string"), F.lit("@x.ae"))).alias("notes")).alias("c"))
    out = structured.redact_structured(rows, SECRET, TENANT, ["c"], which=CONTACT)
    return out.select("id", "c.phone", "c.amount_note", F.element_at("c.notes", 1).alias("note"))


def tabular_redact(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("05"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("Mobile No"), F.col("c_mktsegment").alias("Segment"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise("a@b.co").alias("Email"))
    out = structured.redact_table(t, SECRET, TENANT)
    return out.select("id", F.col("Mobile No").alias("mobile"), F.col("Segment").alias("segment"), F.col("Email").alias("email"))


def kind_counts(spark, sf_dir):
    return batch.kind_counts(_found(spark, sf_dir, "contact", "EMAIL", "PHONE"), "id")


def corpus_summary(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = D.detect_rows(docs, "doc_id", which=D.detectors("EMAIL"))
    return batch.corpus_summary(found, docs, "doc_id").select("kind", "detections", "files_with", "files")


def top_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = D.detect_rows(docs, "doc_id", which=D.detectors("EMAIL"))
    return batch.top_files(batch.file_summaries(found, docs, "doc_id"), "doc_id").select("doc_id", "total")


def eval_scores(spark, sf_dir):
    found = stored(_found(spark, sf_dir, "contact", "EMAIL", "PHONE").select("id", "start", "end", "kind", "source"), "found")
    # gold: the start of the mail address, for two rows of three
    gold = carrier(spark, sf_dir, "contact").select("id", (F.locate("email ", F.col("text")) + 5).alias("start"), (F.locate("@", F.col("text")) + 2).alias("end"), F.lit("EMAIL").alias("kind"))
    return evaluate.scores(evaluate.outcomes(found, gold.where("id % 3 <> 0"), "id"), "kind")


def conversation_redact(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    out = tokens.anonymize(turns.withColumn("text", F.concat(F.lit("mail u"), F.col("conv_id").cast("string"), F.lit("@x.ae "), "text")), "text", SECRET, TENANT, which=D.detectors("EMAIL"))
    return out.select("conv_id", "turn", "role", "text")


def hook_decisions(spark, sf_dir):
    rows = carrier(spark, sf_dir, "contact").select("id", F.element_at(F.array(*map(F.lit, ["UserPromptSubmit", "PreToolUse", "PreToolUse", "PostToolUse"])), (F.col("id") % 4 + 1).cast("int")).alias("event"), F.when(F.col("id") % 4 == 1, "Write").otherwise("Bash").alias("tool"), F.when(F.col("id") % 3 == 0, F.lit("nothing")).otherwise(F.col("text")).alias("payload"))
    return guard.hook_decision(rows, secret=SECRET, tenant=TENANT, which=CONTACT).select("id", "decision", "summary")


def stream_restore(spark, sf_dir):
    """Chat chunks that split every token after 12 characters; the restored deltas joined are the restored text."""
    done, vault = _round_trip(spark, sf_dir)
    chunk = lambda body: F.concat(F.lit('data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"'), body, F.lit('"}}'))
    n = F.length("text")
    blocks = done.select(F.col("id").cast("string").alias("stream_id"), F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("seq"), chunk(F.substring("text", 1, 12)).alias("block"))), F.transform(F.sequence(F.lit(1), F.ceil((n - 12) / 9).cast("int")), lambda i: F.struct(i.cast("long").alias("seq"), chunk(F.substr("text", (i - 1) * 9 + 13, F.lit(9))).alias("block"))), F.array(F.struct(F.lit(1_000_000).cast("long").alias("seq"), F.lit('data: {"type":"message_stop"}').alias("block"))))).alias("e")).select("stream_id", "e.*")
    out = events.restore_batch(blocks, vault)
    delta = F.get_json_object(F.regexp_replace("block", "^data: ", ""), "$.delta.text")
    joined = out.withColumn("delta", delta).groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", F.coalesce("delta", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"))
    return joined.select(F.col("stream_id").cast("long").alias("id"), "text")


def word_pieces(spark, sf_dir):
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.posexplode(F.split("n_name", "")).alias("i", "c")).where("c <> ''")
    pieces = docs.select("id", "i", F.when(F.col("i") % 3 == 0, F.col("c")).otherwise(F.concat(F.lit("##"), "c")).alias("token"), F.col("i").alias("start"), (F.col("i") + 1).alias("end"), F.when(F.col("i") % 2 == 0, "O").otherwise("B-PER").alias("label"), (F.lit(0.5) + F.col("i") / 100).alias("p"))
    return ner.word_relation(pieces, "id").select("id", F.col("word").cast("int").alias("word"), "start", "end", "label")


QUERIES = {
    "email_spans": email_spans, "email_domains": email_domains, "digit_functions": digit_functions, "scrub_invisible": scrub_invisible, "luhn_numbers": luhn_numbers,
    "iban_remainders": iban_remainders, "kuwait_ids": kuwait_ids, "path_hashes": path_hashes, "title_variants": title_variants, "arabic_normal_forms": arabic_normal_forms,
    "format_kinds": format_kinds, "html_text": html_text, "html_redacted": html_redacted,
    "iban_spans": lambda s, d: _spans(s, d, "account", "IBAN"), "phone_spans": lambda s, d: _spans(s, d, "contact", "PHONE"), "folded_phone_spans": lambda s, d: _spans(s, d, "folded", "PHONE"),
    "identity_spans": lambda s, d: _spans(s, d, "identity", "NATIONAL_ID"), "tax_spans": lambda s, d: _spans(s, d, "invoice", "TAX_NUMBER"), "address_spans": lambda s, d: _spans(s, d, "place", "ADDRESS"),
    "geo_gated": geo_gated, "resolve_overlaps": resolve_overlaps, "context_boost": context_boost, "suppressed": suppressed, "tokenized": tokenized, "anonymize_text": anonymize_text, "vault_records": vault_records,
    "anonymize_hidden": anonymize_hidden, "anonymize_folded": anonymize_folded, "policy_balanced": policy_balanced, "policy_kinds": policy_kinds, "policy_audit": policy_audit, "restore_exact": restore_exact, "restore_fuzzy": restore_fuzzy,
    "leak_gate": leak_gate, "residual_guard": residual_guard, "structured_keys": structured_keys, "structured_redact": structured_redact, "tabular_redact": tabular_redact, "kind_counts": kind_counts, "corpus_summary": corpus_summary,
    "top_files": top_files, "eval_scores": eval_scores, "conversation_redact": conversation_redact, "hook_decisions": hook_decisions, "stream_restore": stream_restore, "word_pieces": word_pieces,
}
