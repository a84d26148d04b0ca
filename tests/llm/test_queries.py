import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
import xxhash

from shelfspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = con.execute(queries.ORACLE_SQL[name])
    found = [d[0] for d in got.description]
    assert sorted(found) == columns
    want = [tuple(r[found.index(c)] for c in columns) for r in got.fetchall()]
    assert sorted(repr(tuple(r)) for r in rows.select(*columns).collect()) == sorted(map(repr, want))


def table(name, columns, sf=SF):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_op1_equals_the_library(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    library = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op1_bpe(spark, SF).collect()}
    docs = table("documents", "doc_id, text")
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op2_equals_brute_force(spark):
    prints = {}
    for doc_id, text in table("documents", "doc_id, text"):
        words = lowered(text)
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    for a, x in prints.items():
        for b, y in prints.items():
            if a < b and (x ^ y).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {i: (f"{x:016x}", root[i]) for i, x in prints.items()}


def test_op5_base_and_folds(spark):
    docs = [(i, [*lowered(t), None]) for i, t in table("documents", "doc_id, text")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, words in docs if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op5_katz(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, words in docs:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_op6_lists_what_it_finds(spark):
    rows = queries.op6_licenses(spark, SF).collect()
    assert len(rows) == len(table("documents", "doc_id"))
    assert all(r.n_finds == len(r.licenses) and r.found == ",".join(sorted({x.license for x in r.licenses})) for r in rows)
    texts = dict(table("documents", "doc_id, text"))
    marked = {i for i, t in texts.items() if "Licensed under the Apache License, Version 2.0" in (t or "")}
    assert marked
    assert marked <= {r.doc_id for r in rows if "Apache-2.0" in r.found}


def test_op7_on_rows_that_it_has_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    assert len(got) == len(table("documents", "doc_id", sf))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [(q, got[i].predicted) for i, q in table("labels", "doc_id, quality", sf) if q is not None and got[i].held_out]
    assert sum(q == p for q, p in unseen) / len(unseen) > 0.9
    assert sum(p == 0 for q, p in unseen if q == 0) / sum(q == 0 for q, _ in unseen) > 0.6
