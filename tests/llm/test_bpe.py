import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import bpe
from loomline.llm.queries import op3_bpe, vocabulary
from tests.llm.cases import edge_docs, no_docs

tokenizers = pytest.importorskip("tokenizers")
TOK = tokenizers.Tokenizer.from_file(vocabulary())
ENC = bpe.Encoder(bpe.load_vocabulary(vocabulary()))


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t aeThing's1,.!<|endoftext|>é漢\x1c\x85\u2003")), st.characters(codec="utf-8")), max_size=60))
def test_any_text_as_the_library_does(text):
    ids = ENC.encode_batch([text])[0].tolist()
    assert ids == TOK.encode(text, add_special_tokens=False).ids
    assert ENC.decode(ids) == TOK.decode(ids, skip_special_tokens=False)


def test_all_ways_of_merging_agree():
    v = ENC.v
    words = [w.encode() for w in (" unbelievable", "aaaaaaaaaaaaaaaaaaaaaaa", " Ouwhea", "thththththth", "x" * 31, "zq" * 15, *(f" {a}{b}{c}" for a in ("ou", "er", "hen", "and") for b in ("wh", "ea", "ti") for c in ("reth", "sh", "onst")))]
    got, size = v.merge_all(*bpe.runs([w.decode() for w in words]))
    parts = np.split(got, np.cumsum(size)[:-1])
    assert [p.tolist() for p in parts] == [v.merge_long(w) for w in words]
    flat, size, exact = v.encode_words(*bpe.runs([w.decode() for w in words]))
    assert exact > 0 and [p.tolist() for p in np.split(flat, np.cumsum(size)[:-1])] == [v.outer[v.merge_long(w)].tolist() for w in words]


def test_every_token_is_its_own_encoding():
    assert ENC.v.sound.all()


def test_a_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    e = bpe.Encoder(bpe.load_vocabulary(vocabulary()))
    for t in ("one two three four", "five one  two", "six seven one"):
        assert e.encode_batch([t])[0].tolist() == TOK.encode(t, add_special_tokens=False).ids


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = TOK.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(TOK.decode(ids, skip_special_tokens=False)))


def test_edges_and_round_trip(spark):
    df = edge_docs(spark)
    coded = bpe.encode(df, vocabulary())
    assert coded.count() == df.count()
    back = sorted((r["text"] for r in bpe.decode(coded, vocabulary()).collect()), key=str)
    assert back == sorted((r["text"] or "" for r in df.collect()), key=str)
    assert bpe.round_trip(no_docs(spark), vocabulary()).count() == 0
    empty = [r for r in bpe.round_trip(df, vocabulary()).collect() if r["doc_id"] in (1, 2)]
    assert {(r["n_tokens"], r["ids_sha256"]) for r in empty} == {(0, sha(""))}
