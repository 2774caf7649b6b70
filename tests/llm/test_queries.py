"""Every registered query on the smallest driver tables: against SQL where there is
some, else the columns, rows and a plain recomputation of what the contract fixes."""

import os
import re

import pytest

from plumbline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")

PER_DOCUMENT = {
    "op1_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op2_simhash_dedup": {"doc_id", "fingerprint", "component_id"},
    "op3_quality": {"doc_id", "expected_grade", "tail_probability", "keep"},
    "op7_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op8_lm_score": {"doc_id", "n_tokens", "score"},
    "op9_line_dedup": {"doc_id", "n_lines", "n_removed", "text"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_one_row_for_each_document(spark, texts, name):
    got = queries.QUERIES[name](spark, DATA)
    assert PER_DOCUMENT[name] <= set(got.columns)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert set(rows) == set(texts) and got.count() == len(texts)
    if name == "op1_token_counts":
        P = pytest.importorskip("public_tokenizers")
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
        for i, text in texts.items():
            n = len(lib.encode(text or "", add_special_tokens=False).ids)
            assert (rows[i]["n_tokens"], rows[i]["over_limit"], rows[i]["n_bytes"]) == (n, n > 1024, len((text or "").encode()))
    if name == "op2_simhash_dedup":
        import xxhash

        def fingerprint(text):
            words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
            hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 4]), 42) for j in range(max(1, len(words) - 3))] if words else []
            return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

        prints = {i: fingerprint(t) for i, t in texts.items()}
        component = {i: i for i in texts}
        changed = True
        while changed:
            changed = False
            for a in texts:
                for b in texts:
                    if component[b] < component[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                        component[a], changed = component[b], True
        assert {i: (r["fingerprint"], r["component_id"]) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", component[i]) for i in texts}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(queries.ORACLE[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.column_names)
    columns = sorted(got.columns)
    plain = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    assert plain(got.collect()) == plain(want.to_pylist())


def test_neighbours_against_brute_force(spark):
    import numpy as np

    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r["embedding"] is not None}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    got = {}
    for r in queries.op4_ann(spark, DATA).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    asked = [i for i in vectors if i % 20 == 0]
    assert set(got) == set(asked)
    ids, m, hits = np.array(list(vectors)), np.stack(list(vectors.values())), []
    for q in asked:
        s = m @ vectors[q]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert [i for i, _ in got[q]] == [i for i, _ in sorted(got[q], key=lambda x: (-x[1], x[0]))] and len(got[q]) == min(20, len(ids) - 1)
        assert all(abs(score - vectors[i] @ vectors[q]) < 1e-9 for i, score in got[q])
        hits.append(len({i for i, _ in got[q]} & set(best)) / len(best))
    assert np.mean(hits) >= 0.9


def test_packed_pieces_are_the_texts(spark, texts):
    pytest.importorskip("public_tokenizers")
    pieces = {}
    for r in queries.op5_packing(spark, DATA).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start_byte"], r["end_byte"]))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ends = sorted(pieces[i])
        assert ends[0][0] == 0 and ends[-1][1] == len((text or "").encode()) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
