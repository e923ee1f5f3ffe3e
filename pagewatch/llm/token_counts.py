"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Documents are read in blocks. A block's row holds its documents' pre-token frequencies (numbers into the
block's distinct pre-tokens, packed) and those pre-tokens, dealt by hash (see dealing). A shard gathers its
part of all blocks' pre-tokens, counts each distinct one's pieces once, and answers every block by
place; a block's frequencies and the answers meet by block, and the products are summed. Token ids are never kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewatch.llm.dealing import ASKED, ASKED_ARROW, CELLS, answered, dealt, pack, unpack, values_of
from pagewatch.llm.pretokens import PreTokenizer, coded
from pagewatch.llm.shared import slices, table, texts

#: Characters of a block's texts before it is closed.
BLOCK = 6 << 20
#: Pre-tokens given to the library at once.
CALL = 20_000

BLOCKS = f"block long, doc_ids binary, nulls binary, n_bytes binary, n_pairs binary, codes binary, freqs binary, asked {ASKED}"


def scan_parts(docs: DataFrame) -> int:
    """Partitions that Spark's plan reads docs in; runs nothing."""
    return docs._jdf.queryExecution().toRdd().getNumPartitions()


def _block(splitter: PreTokenizer, doc_ids: list, found: list[str]) -> dict:
    tokens, owner = splitter.split(found)
    codes, distinct = coded(tokens)
    rank, asked = dealt([w.encode("utf-8", "surrogatepass") for w in distinct], np.ones(len(distinct), np.int64), CELLS)
    keys, freqs = np.unique(owner.astype(np.int64) * max(len(distinct), 1) + rank[codes], return_counts=True)
    docs, numbers = np.divmod(keys, max(len(distinct), 1))
    n_pairs = np.bincount(docs, minlength=len(found))
    gaps = np.diff(numbers, prepend=0)
    firsts = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
    gaps[firsts] = numbers[firsts]
    return {
        "block": uuid.uuid4().int >> 65, "doc_ids": pack(np.array([d or 0 for d in doc_ids]), "<i8"), "nulls": pack(np.array([d is None for d in doc_ids]), "u1"),
        "n_bytes": pack(np.array([len(t.encode("utf-8", "surrogatepass")) for t in found]), "<i8"), "n_pairs": pack(n_pairs, "<u4"),
        "codes": pack(gaps, "<u4"), "freqs": pack(freqs, "<u4"), "asked": asked,
    }


def blocks(docs: DataFrame, vocabulary: str, words: bool) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "nulls", "n_bytes", "n_pairs", "codes", "freqs")), ("asked", ASKED_ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = PreTokenizer(vocabulary, words)
        ids, found, size = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                found.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield pa.RecordBatch.from_pylist([_block(splitter, ids, found)], schema)
                    ids, found, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(splitter, ids, found)], schema)

    return texts(docs).mapInArrow(run, BLOCKS)


def _pieces(vocabulary: str, words: bool):
    """Answers each pre-token with the number of its pieces."""

    def answer(keys: list[bytes], _: np.ndarray) -> tuple[np.ndarray, None]:
        tokenizer = PreTokenizer(vocabulary, words).tokenizer
        found = [k.decode("utf-8", "surrogatepass") for k in keys]
        return np.array([len(e) for at in range(0, len(found), CALL) for e in tokenizer.encode_batch_fast(found[at : at + CALL], add_special_tokens=False)], np.int64), None

    return answer


def _sum(left: pa.Table, right: pa.Table) -> pa.Table:
    row = left.to_pylist()[0]
    pieces = values_of(right) if right.num_rows else np.zeros(1, np.int64)
    n_pairs, gaps, freqs = (unpack(row[k], "<u4").astype(np.int64) for k in ("n_pairs", "codes", "freqs"))
    ends = np.cumsum(n_pairs)
    total = np.cumsum(gaps)
    before = np.r_[0, total][ends - n_pairs]
    numbers = total - np.repeat(before, n_pairs)
    sums = np.r_[0, np.cumsum(freqs * pieces[numbers])]
    ids = pa.array(unpack(row["doc_ids"], "<i8"), mask=unpack(row["nulls"], "u1").astype(bool))
    return pa.table({"doc_id": ids, "n_bytes": pa.array(unpack(row["n_bytes"], "<i8")), "n_tokens": pa.array(sums[ends] - sums[ends - n_pairs])})


def token_counts(docs: DataFrame, vocabulary: str, words: bool = True) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens per row of docs, as the library counts the whole text.

    vocabulary: a file of the tokenizers library, at the same path on every machine. words: whether its
    pre-tokens are lower-cased words (see PreTokenizer). A null text counts as empty: no bytes, no tokens.
    Null doc_ids and repeated rows come back one for one; an empty table gives an empty result. Texts of any length
    are counted whole; a block closes after the text that fills it. Other columns are ignored.
    """
    made = table(blocks(docs, vocabulary, words), "token-blocks")
    answers = answered(made, _pieces(vocabulary, words))
    frequencies = made.select("block", "doc_ids", "nulls", "n_bytes", "n_pairs", "codes", "freqs")
    return frequencies.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
