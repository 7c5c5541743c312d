"""Side inputs: gold spans, phrases, places, transcripts, and the vault file."""

from __future__ import annotations

import base64
import codecs
import hashlib
import hmac
import itertools
import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.functions import pandas_udf

from .. import fixed
from ..functions import text
from ..operators.detect import Gazetteer, Suppressor
from ..session import shared_dir
from .formats import json_leaves

_GOLD = "file string, start int, end int, kind string, text string, confidence_floor double"
_VAULT = "kind string, token string, value string, normalized string"


def read_gold(spark: SparkSession, gold: str, *folders: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans in code points, texts, counts) of gold rows and the first folder's text of each file.

    Byte offsets become code points; spans inside a character are left out, and
    so are spans of other kinds, which ``counts`` has: one row of files, gold
    (spans in scope) and out_of_scope.
    """
    texts = None
    for rank, folder in enumerate(folders):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.lit(rank).alias("rank"), F.decode("content", "UTF-8").alias("text"))
        texts = read if texts is None else texts.unionByName(read)
    rows = spark.read.schema(_GOLD).json(gold).drop("text")
    texts = texts.join(rows.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.min_by("text", "rank").alias("text"))
    return gold_spans(rows, texts), texts, gold_counts(rows, texts)


def gold_spans(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Gold rows (file, start, end, kind) in scope, in code points of their texts."""
    placed = rows.where(F.col("kind").isin(*fixed.KINDS)).join(texts, "file").select("file", text.byte_to_char(F.col("text"), F.col("start")).alias("start"), text.byte_to_char(F.col("text"), F.col("end")).alias("end"), "kind")
    return placed.where("start is not null and end is not null")


def gold_counts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """files, gold spans and spans out of scope, of the gold rows that have a text."""
    here = rows.join(texts.select("file"), "file", "left_semi")
    inside = F.col("kind").isin(*fixed.KINDS)
    spans = gold_spans(rows, texts).agg(F.count("*").alias("gold"))
    return here.agg(F.countDistinct("file").alias("files"), F.count_if(~inside).alias("out_of_scope")).crossJoin(spans).select("files", "gold", "out_of_scope")


def read_phrases(spark: SparkSession, path: str) -> Suppressor:
    return Suppressor.from_text("\n".join(r.value for r in spark.read.text(path).collect()))


def read_places(spark: SparkSession, path: str) -> Gazetteer:
    return Gazetteer.from_data(json.loads(spark.read.text(path, wholetext=True).first().value))


def assistant_messages(lines: DataFrame, column: str = "value", thinking: bool = False) -> DataFrame:
    """timestamp and text of the assistant's blocks of a transcript, one JSON object per line."""
    schema = "type string, timestamp string, message struct<content:array<struct<type:string,text:string,thinking:string>>>"
    rows = lines.select(F.from_json(column, schema).alias("j")).where("j.type = 'assistant'").select("j.timestamp", F.posexplode("j.message.content").alias("i", "b"))
    wanted = ["text", "thinking"] if thinking else ["text"]
    return rows.where(F.col("b.type").isin(*wanted)).select("timestamp", "i", F.when(F.col("b.type") == "thinking", F.col("b.thinking")).otherwise(F.col("b.text")).alias("text")).where("text is not null")


def newest(files: DataFrame) -> DataFrame:
    """The most recently changed file of a ``binaryFile`` frame."""
    return files.agg(F.max_by("path", "modificationTime").alias("path"))


#: Bytes that go through the cipher in one call (of which base64 leaves no rest), and rows of a vault that the driver holds at once.
_PIECE, _ROWS = 3 << 18, 50_000


def _cipher(spark: SparkSession, secret: str, nonce: bytes, name: str = "ChaCha20-Poly1305"):
    """An encrypting cipher of the JVM that takes a text piece by piece; the key is the secret's SHA-256."""
    jvm = spark.sparkContext._jvm
    key = jvm.javax.crypto.spec.SecretKeySpec(hashlib.sha256(secret.encode()).digest(), "ChaCha20")
    cipher = jvm.javax.crypto.Cipher.getInstance(name)
    # of the plain stream, block 0 makes the key of the tag
    cipher.init(1, key, jvm.javax.crypto.spec.IvParameterSpec(nonce) if name.endswith("Poly1305") else jvm.javax.crypto.spec.ChaCha20ParameterSpec(nonce, 1))
    return cipher


def _pieces(parts: Iterable[bytes], size: int = _PIECE) -> Iterator[bytes]:
    """The same bytes in pieces of one size."""
    held = bytearray()
    for part in parts:
        held += part
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)


def _encrypted(cipher, plain: Iterable[bytes]) -> Iterator[bytes]:
    for piece in _pieces(plain):
        yield bytes(cipher.update(piece) or b"")
    yield bytes(cipher.doFinal())


def save_vault(vault: DataFrame, path: str, secret: str) -> None:
    """One encrypted file of a vault; its rows pass through the driver, which holds a partition of them."""

    def plain():
        rows = vault.select("kind", "token", "value", "normalized").orderBy("token").toLocalIterator()
        yield b'{"records": ['
        for i, r in enumerate(rows):
            yield ((", " if i else "") + json.dumps(r.asDict(), ensure_ascii=False)).encode()
        yield b"]}"

    nonce = os.urandom(12)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(json.dumps({"version": 1, "cipher": "chacha20poly1305", "nonce": base64.b64encode(nonce).decode(), "ciphertext": ""}).encode()[:-2])
        for piece in _pieces(_encrypted(_cipher(vault.sparkSession, secret, nonce), plain())):
            f.write(base64.b64encode(piece))
        f.write(b'"}')
    os.replace(part, path)


_HEAD = re.compile(rb'\A[^\\]*"ciphertext"\s*:\s*"')


def _opened(path: str) -> tuple[bytes, Callable[[], Iterator[bytes]], bytes]:
    """(nonce, pieces of the ciphertext, tag) of a vault file, which is read piece by piece if its ciphertext comes last."""
    with open(path, "rb") as f:
        head = _HEAD.match(f.read(4096))
        size = f.seek(0, 2)
        f.seek(max(0, size - 64))
        end = f.read()
    stop = size - len(end) + end.rfind(b'"')
    if head and b'"nonce"' in head[0] and re.fullmatch(rb'"\s*\}\s*', end[end.rfind(b'"') :]):
        at, nonce = head.end(), base64.b64decode(json.loads(head[0] + b'"}')["nonce"])

        def coded():
            with open(path, "rb") as f:
                f.seek(at)
                for i in range(at, stop, 4 << 18):
                    yield f.read(min(4 << 18, stop - i))
    else:
        with open(path, encoding="utf-8") as f:
            box = json.load(f)
        nonce = base64.b64decode(box["nonce"])
        coded = lambda: iter([box["ciphertext"].encode()])

    def body():
        """All but the tag."""
        held = b""
        for piece in coded():
            held += base64.b64decode(piece)
            yield held[:-16]
            held = held[-16:]

    tag = b""
    for piece in coded():
        tag = (tag + base64.b64decode(piece))[-16:]
    return nonce, body, tag


def _records(plain: Iterator[bytes]) -> Iterator[dict]:
    """The records of a vault's JSON text, as its pieces come."""
    decoded, scan = codecs.iterdecode(plain, "utf-8"), json.JSONDecoder().raw_decode
    buffer, at = "", 0
    while not (start := re.match(r'\s*\{\s*"records"\s*:\s*\[', buffer)):
        if (more := next(decoded, None)) is None:  # other keys come first
            yield from json.loads(buffer)["records"]
            return
        buffer += more
    at = start.end()
    while True:
        at = re.compile(r"[\s,]*").match(buffer, at).end()
        if buffer[at : at + 1] == "]":
            return
        try:
            record, at = scan(buffer, at)
        except ValueError:
            if (more := next(decoded, None)) is None:
                raise
            buffer, at = buffer[at:] + more, 0
            continue
        yield record


def load_vault(spark: SparkSession, path: str, secret: str) -> DataFrame:
    """The vault of a file as a stored table; a missing file is an empty vault, unknown kinds are left out.

    The JVM gives no decrypted byte before it has the whole text, so the file is
    read twice: what the plain stream decrypts must give the file's tag when it
    is encrypted again, and only then are its records read.
    """
    if not os.path.exists(path):
        return spark.createDataFrame([], _VAULT)
    nonce, body, tag = _opened(path)
    plain = lambda: _encrypted(_cipher(spark, secret, nonce, "ChaCha20"), body())
    again = b""
    for piece in _encrypted(_cipher(spark, secret, nonce), plain()):
        again = (again + piece)[-16:]
    if not hmac.compare_digest(again, tag):
        raise ValueError("the vault file does not belong to this secret, or was changed")
    rows = ((r["kind"], r["token"], r["value"], r["normalized"]) for r in _records(plain()) if r["kind"] in fixed.KINDS)
    table = f"{shared_dir(spark, 'loaded')}/table"
    spark.createDataFrame([], _VAULT).write.parquet(table)
    while part := list(itertools.islice(rows, _ROWS)):
        columns = [pa.array(c, pa.string()) for c in zip(*part, strict=True)]
        spark.createDataFrame(pa.table(columns, names=["kind", "token", "value", "normalized"])).write.mode("append").parquet(table)
    return spark.read.schema(_VAULT).parquet(table)


def json_text_leaves(body: Column) -> Column:
    """(pointer, text) of the string values of a JSON text at any depth, by sorted keys; numbers, booleans and nulls are no text."""
    return _string_leaves(body)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("pointer", T.StringType()), T.StructField("text", T.StringType())])))
def _string_leaves(bodies: pd.Series) -> pd.Series:
    def one(body):
        try:
            return None if body is None else [{"pointer": p, "text": t} for p, t in json_leaves(json.loads(body))]
        except ValueError:
            return None

    return bodies.map(one)


class TranscriptTail(DataSource):
    """Streaming source ``transcript_tail``: the complete lines that are added to the newest file of a folder.

    It begins at the end of the file that is newest then (option ``from`` =
    ``start``: at its beginning), goes on with a newer file when there is one, and
    from the beginning of a file that became shorter.  The folder is read by the
    driver, which must have it mounted.
    """

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return "path string, value string"

    def simpleStreamReader(self, schema):
        return TailReader(self.options["path"], self.options.get("from", "end"))


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, begin: str):
        self.folder, self.begin = folder, begin

    def newest(self) -> str:
        files = [e for e in os.scandir(self.folder) if e.is_file()] if os.path.isdir(self.folder) else []
        return max(files, key=lambda e: (e.stat().st_mtime_ns, e.path)).path if files else ""

    def initialOffset(self) -> dict:
        path = self.newest()
        return {"path": path, "at": os.path.getsize(path) if path and self.begin == "end" else 0}

    def read(self, start: dict):
        path, at = start["path"], start["at"]
        if (latest := self.newest()) != path:
            path, at = latest, 0
        if not path:
            return iter([]), start
        if os.path.getsize(path) < at:
            at = 0
        lines, stop = self.lines(path, at, None)
        return iter(lines), {"path": path, "at": stop}

    def readBetweenOffsets(self, start: dict, end: dict):
        same = start["path"] == end["path"] and start["at"] <= end["at"]
        return iter(self.lines(end["path"], start["at"] if same else 0, end["at"])[0])

    @staticmethod
    def lines(path: str, at: int, stop: int | None) -> tuple[list[tuple[str, str]], int]:
        with open(path, "rb") as f:
            f.seek(at)
            data = f.read() if stop is None else f.read(stop - at)
        whole = data[: data.rfind(b"\n") + 1]
        return [(path, x.decode("utf-8", "replace")) for x in whole.split(b"\n")[:-1]], at + len(whole)
