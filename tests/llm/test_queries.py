"""The queries without SQL, over a whole table: against the libraries, brute force and held-out labels."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm import brute_spans  # noqa: E402

from docloom.llm import decontam, toxicity  # noqa: E402
from docloom.llm import queries as Q  # noqa: E402
from docloom.llm.common import ALNUM, word_hashes, word_spans  # noqa: E402

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in Q.read(spark, sf, "documents").select("doc_id", "text").collect()}


def test_op4_base_spans_and_counts(spark, sf, texts):
    got = Q.op4_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r.doc_id]))
        every = [s.split(":") for s in r.spans.split(",") if s]
        assert r.base_sha256 == sha(base) and set(base.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in every) for k in ("email", "ip", "card", "phone")]
        order = [(("email", "ip", "card", "phone").index(k), int(a)) for k, a, _ in every]
        assert order == sorted(order)


def test_op6_equals_library(spark, sf, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in Q.op6_sentencepiece(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = sp.encode(t)
        proto = sp.encode(t, return_type="proto").pieces
        spans = np.array([(p.begin, p.end) for p in proto], "<i8").tobytes()
        whole = not any(p.piece.startswith("<0x") for p in proto)  # of a character's bytes the library gives all but one an empty span
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
        assert not whole or got[i].spans_sha256 == hashlib.sha256(spans).hexdigest()


def test_op8_against_every_item_and_document(spark, sf, texts):
    """Every document against every item by edit distance, which the query's proposals must find and its matches must be."""
    h = lambda t: (lambda b: word_hashes(b, *word_spans(b, np.array([0, len(b)]), ALNUM)[:2], lower=True))(np.frombuffer(t.encode(), np.uint8))
    items = {r.item_id: h(r.text) for r in Q.read(spark, sf, "benchmark").collect()}
    want = {}
    for i, t in texts.items():
        w = h(t)
        for j, item in items.items():
            k = len(item) // 4
            if np.isin(item, w).sum() >= len(item) - k:
                d = decontam.edit_distance_in(item, w)[0]
                if d <= k:
                    want[i, j] = d
    got = {(r.doc_id, r.item_id): r.n_edits for r in Q.op8_decontamination(spark, sf).collect()}
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want)


def test_op10_equals_library(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary("byte_bpe_50k.json"))
    for r in Q.op10_token_count(spark, sf).collect():
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize("name,label,m,fold,cut,least", [("op1_toxicity", "toxic", 4, 2, 0.3, 0.8), ("op7_quality", "quality", 3, 1, 0.5, 0.95)])
def test_classifiers_hold_on_held_out_rows(spark, sf, name, label, m, fold, cut, least):
    """With the few labels of sf0.01: toxicity learns from 37 toxic rows there and is tested on 14."""
    from pyspark.sql import functions as F

    sf01 = os.path.join(os.path.dirname(sf), "sf0.01")
    rows = Q.queries()[name](spark, sf01).collect()
    y = {r.doc_id: r[label] for r in Q.read(spark, sf01, "labels").where(F.col(label).isNotNull()).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == fold) for r in rows)
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    pos, neg = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc >= least


def test_toxicity_forward_pass_equals_brute_force():
    """Scores by loops over every position, width and filter."""
    rng = np.random.default_rng(7)
    rows = [" ".join(rng.choice(["vile", "fine", "calm", "stone", "river", "hate"], 12)) for _ in range(120)]
    y = np.array([float("vile" in t or "hate" in t) for t in rows])
    m = toxicity.train(rows, y, ["en"] * len(rows), visits=1500)
    texts = [rows[0], "river", "", "calm stone vile river calm"]
    enc = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(enc), np.uint8), np.r_[0, np.cumsum([len(e) for e in enc])]
    got = toxicity.logits(m, *toxicity.tokens(buf, off))
    assert np.allclose(got, [slow_logit(m, t) for t in texts], atol=1e-3)


def slow_logit(m, text):
    rows, _ = toxicity.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    x = [sum(m.embed[r].astype(float) for r in row) for row in rows]
    z, col = m.shift, 0
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(x[p + j] @ m.conv[:, col + j * toxicity.FILTERS + f]) for j in range(w) if p + j < len(x)) for p in range(len(x) - toxicity.PAD + 1))
            z += max(0.0, best + m.bias[k * toxicity.FILTERS + f]) * m.out[k * toxicity.FILTERS + f]
        col += w * toxicity.FILTERS
    return z


def test_trained_net_beats_word_log_odds():
    """What training adds to the start: word order matters here, which a list of words can't know."""
    rng = np.random.default_rng(5)
    words = ["you", "are", "not", "a", "fool", "friend", "he", "is"]
    rows = [" ".join(rng.choice(words, 14)) for _ in range(900)]
    y = np.array([float(re.search(r"\ba fool\b", t) is not None) for t in rows])
    m = toxicity.train(rows[:700], y[:700], ["en"] * 700, visits=20_000)
    start = toxicity.train(rows[:700], y[:700], ["en"] * 700, epochs=0)
    enc = [t.encode() for t in rows[700:]]
    buf, off = np.frombuffer(b"".join(enc), np.uint8), np.r_[0, np.cumsum([len(e) for e in enc])]
    auc = lambda s: np.mean([(a > b) + 0.5 * (a == b) for a in s[y[700:] == 1] for b in s[y[700:] == 0]])
    assert auc(toxicity.logits(m, *toxicity.tokens(buf, off))) > auc(toxicity.logits(start, *toxicity.tokens(buf, off))) + 0.05
