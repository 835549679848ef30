"""The registered queries against their SQL, brute force or the library, on the smallest test tables."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from check_oracle import compare, connect
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwise.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, table):
    return spark.read.parquet(f"{SF_DIR}/{table}.parquet").collect()


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def top(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_tokens_and_codes(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = {r["doc_id"]: r for r in QUERIES["op5_token_counts"](spark, SF_DIR).collect()}
    codes = {r["doc_id"]: r for r in QUERIES["op9_bpe"](spark, SF_DIR).collect()}
    for row in rows_of(spark, "documents"):
        ids = library.encode(row["text"], add_special_tokens=False).ids
        assert counts[row["doc_id"]]["n_tokens"] == codes[row["doc_id"]]["n_tokens"] == len(ids)
        assert counts[row["doc_id"]]["n_bytes"] == len(row["text"].encode())
        assert codes[row["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert codes[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def shingles(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    if not found:
        return frozenset()
    return frozenset([tuple(found)] if len(found) < words else [tuple(found[i : i + words]) for i in range(len(found) - words + 1)])


def test_near_duplicates(spark):
    sets = {r["doc_id"]: shingles(r["text"], 4) for r in rows_of(spark, "documents")}
    groups, ids = Groups(sets), sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                groups.join(a, b)
    for row in QUERIES["op7_signatures"](spark, SF_DIR).collect():
        top = groups.top(row["doc_id"])
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[row["doc_id"]]), top, top == row["doc_id"])


def test_language_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in rows_of(spark, "documents")}
    found = [r for r in QUERIES["op4_language"](spark, SF_DIR).collect() if r["held_out"]]
    assert len(found) > 40
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.95 * len(found)


def test_personal_data_base(spark):
    def plain(text):
        spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(part) <= 255 for part in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
                spans.append(("card", *m.span()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
        return ",".join(":".join(map(str, s)) for s in spans)

    texts = {r["doc_id"]: r["text"] for r in rows_of(spark, "documents")}
    some = 0
    for row in QUERIES["op10_personal_data"](spark, SF_DIR).collect():
        told = plain(texts[row["doc_id"]])
        some += bool(told)
        assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(row["spans"].split(","))
        assert told or not row["spans"]
    assert some


def test_vector_links(spark):
    rows = [r for r in rows_of(spark, "embeddings")]
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    links = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    counts = {r["vec_id"]: int(n) for r, n in zip(rows, links.sum(axis=1), strict=True)}
    found = {r["vec_id"]: r["n_links"] for r in QUERIES["op1_vector_graph"](spark, SF_DIR).collect()}
    assert found.keys() == counts.keys() and all(found[i] <= counts[i] for i in counts)
    assert sum(found.values()) >= 0.9 * sum(counts.values())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    result = corpus_pipeline.run(spark, SF_DIR).collect()
    assert set(docs.columns) < set(result[0].asDict())
    assert {r["doc_id"] for r in result} <= {r["doc_id"] for r in docs.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in result[:50]:
        assert row["n_tokens"] == len(library.encode(row["text"], add_special_tokens=False))
    assert max(collections.Counter(r["doc_id"] for r in result).values()) <= 2
