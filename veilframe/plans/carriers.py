"""Carrier texts: identifiers written into sentences from the keys of the driver's tables.

The tables hold no Gulf identifiers, so the queries read these projections.
They are written in SQL that Spark and DuckDB share and stand in front of every
query's own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(c_custkey AS STRING)"
_EVEN = "c_custkey % 2 = 0"
#: A name of letters that differs by key.
_NAME = "translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij')"


def _two(yes: str, no: str, rest: str) -> str:
    """A text that an even key makes a match and an odd one must not."""
    return f"concat(CASE WHEN {_EVEN} THEN {yes} ELSE {no} END, {rest})"


_CHECK = "98 - (c_custkey * 1000000 + 281000) % 97"

#: name -> (table, key, text)
TEXTS = {
    "contact": ("customer", "c_custkey", f"concat('Client ', c_name, ' phone 05', lpad(CAST(c_custkey % 100000000 AS STRING), 8, '0'), ' email C', {_K}, '@Mail.example.ae, +966 5', lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0'), ' end')"),
    "hidden": ("customer", "c_custkey", f"concat('call 05\u200b', lpad(CAST(c_custkey % 100000000 AS STRING), 8, '0'), ' or c', {_K}, '@ex\u00adample.\u0430e now')"),
    "folded": ("customer", "c_custkey", f"concat('جوال ', translate(concat('05', lpad(CAST(c_custkey % 100000000 AS STRING), 8, '0')), '0123456789', '٠١٢٣٤٥٦٧٨٩'), ' ثم')"),
    "account": ("customer", "c_custkey", f"concat('Transfer to IBAN SA', lpad(CAST({_CHECK} + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS STRING), 2, '0'), lpad({_K}, 20, '0'), ' today')"),
    "identity": ("customer", "c_custkey", f"concat('Emirates ID 784-1990-', lpad({_K}, 7, '0'), '-', CAST(c_custkey % 10 AS STRING), '; Civil ID: 2', lpad({_K}, 11, '0'), ' | 9', lpad({_K}, 9, '0'), ' |')"),
    "company": ("customer", "c_custkey", f"concat('Commercial Registration (CR) Number: 10', lpad({_K}, 8, '0'), ', VAT number: 3', lpad({_K}, 13, '0'), '3 and CR Test')"),
    "invoice": ("customer", "c_custkey", f"concat(CASE WHEN c_custkey % 2 = 0 THEN 'Tax Invoice' ELSE 'Delivery' END, ' ref 1', lpad({_K}, 14, '0'), ' and ', repeat('7', 15))"),
    "place": ("customer", "c_custkey", f"concat('Visit P.O. Box ', CAST(c_custkey % 9000 + 1000 AS STRING), ' by ', CASE WHEN c_custkey % 2 = 0 THEN 'Riyadh 1' ELSE 'Jeddah 2' END, lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' today')"),
    "gulf_id": ("customer", "c_custkey", _two("'CPR: '", "'Ref: '", f"'8', lpad({_K}, 8, '0'), ' end'")),
    "bare_vat": ("customer", "c_custkey", f"concat('Account 3', lpad({_K}, 13, '0'), CASE WHEN {_EVEN} THEN '3' ELSE '4' END, ' end')"),
    "labelled": ("customer", "c_custkey", f"CASE WHEN c_custkey % 3 = 0 THEN concat('Registered address: Tower ', {_K}, ' Palm Zone') WHEN c_custkey % 3 = 1 THEN concat('address: the following ', {_K}, ' items') ELSE concat('address:', repeat(' ', 12), '. ', {_K}) END"),
    "building": ("customer", "c_custkey", _two("'Go to BLDG no: B-'", "'Go to BLOCK no: B-'", f"{_K}, ' now'")),
    "postal": ("customer", "c_custkey", _two("'Postal code: '", "'Parcel code: '", "CAST(10000 + c_custkey % 80000 AS STRING), ' end'")),
    "district": ("customer", "c_custkey", _two("'District Ol'", "'district ol'", f"{_NAME}, ' 7'")),
    "street": ("customer", "c_custkey", _two("'Street: Palm'", "'Strasse: Palm'", f"{_NAME}, '.'")),
    "arabic_street": ("customer", "c_custkey", _two("'شارع Palm'", "'سوق Palm'", f"{_K}, ' .'")),
    "compound": ("customer", "c_custkey", _two("'حي النخيل، شارع Palm'", "'سوق النخيل - Palm'", f"{_K}, CASE WHEN {_EVEN} THEN '، الرياض 12345' ELSE '' END")),
    "anchor": ("customer", "c_custkey", f"concat('Palm ', {_K}, ' Plaza, ', CASE WHEN {_EVEN} THEN 'Riyadh' ELSE 'Paris' END, '; x')"),
    "road": ("customer", "c_custkey", f"concat('9 King Palm', {_NAME}, CASE WHEN {_EVEN} THEN ' Road' ELSE ' Rood' END, ' 5')"),
    "turned": ("customer", "c_custkey", _two("'عراش Palm'", "'قوس Palm'", f"{_K}, ' .'")),
    "letters_iban": ("customer", "c_custkey", "concat('to QA11ABCDEFGHIJKLMNOPQRSTUVW', CASE WHEN c_custkey % 2 = 0 THEN 'XY' ELSE 'XX' END, ' by ', CAST(c_custkey AS STRING))"),
}
CARRIERS = ",\n".join(f"{name} AS (SELECT {key} AS id, {body} AS text FROM {table})" for name, (table, key, body) in TEXTS.items())


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, body = TEXTS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{key} AS id", f"{body} AS text")
