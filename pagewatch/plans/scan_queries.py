"""Queries of the signature scan."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from pagewatch.operators import signatures
from pagewatch.plans.catalogue import SQL_DOCUMENTS, query, read

#: Signatures of which no body has any, made from their numbers; every third has gaps.
MANY = 10_000
#: Signatures that bodies have, and the same over a body's hexadecimal digits.
FOUND = [("hashes", "232323", "232323"), ("marks", "2121", "2121"), ("hash-any-hash", "2323??23", "2323..23"), ("the-and", "746865 {1-9} 616e64", "746865(..){1,9}616e64"), ("de-la", "2064652a6c61", None), ("far", "206f6620*20746f20", "206f6620(..)*20746f20")]


def many_signatures() -> list[tuple[str, str]]:
    made = [(f"made-{i}", hashlib.sha256(str(i).encode()).hexdigest()[:24]) for i in range(MANY)]
    made = [(n, s if i % 3 else f"{s[:8]}??{s[8:16]}{{2-5}}{s[16:]}") for i, (n, s) in enumerate(made)]
    return made + [(n, s) for n, s, _ in FOUND] + [(signatures.TEST_NAME, signatures.TEST_BODY.hex())]


_HITS = ", ".join(f"CASE WHEN regexp_matches(h, '^(..)*{p}') THEN '{n}' END" for n, _, p in FOUND if p)


@query(f"""
WITH b AS (SELECT doc_id, hex(encode(CASE WHEN doc_id % 97 = 0 THEN text || '{signatures.TEST_BODY.decode()}' ELSE text END)) AS u FROM {SQL_DOCUMENTS}),
l AS (SELECT doc_id, lower(u) AS h FROM b)
SELECT doc_id, array_to_string(list_sort(list_filter([{_HITS}, CASE WHEN regexp_matches(h, '^(..)*2064652a6c61') THEN 'de-la' END, CASE WHEN regexp_matches(h, '^(..)*{signatures.TEST_BODY.hex()}') THEN '{signatures.TEST_NAME}' END], lambda x: x IS NOT NULL)), ',') AS hits FROM l""")
def signature_scan(spark, sf_dir):
    """Every text's bytes against more than 10,000 signatures; some texts hold the standard test body."""
    docs = read(spark, sf_dir, "documents").fillna("", ["text"])
    body = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(signatures.TEST_BODY.decode()))).otherwise(F.col("text"))
    found = signatures.scanned(docs.select("doc_id", F.encode(body, "utf-8").alias("body")), many_signatures(), "doc_id")
    return found.select("doc_id", F.array_join("hits", ",").alias("hits"))
