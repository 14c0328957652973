from __future__ import annotations

import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftwell.llm import language_id, packing, pieces, tokens, toxicity
from driftwell.llm.pii import CONTEXT, KINDS, masked, op6_pii, pii_spans

from .data import COLUMNS, frame, rows, words

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9):
        code = language_id.codewords(k)
        assert code.shape[0] == k and min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= max(1, code.shape[1] // 4)


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.op1_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_decoding_equals_a_plain_one():
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "uvwxy", "ff": "abxyz", "gg": "cdwzk"}
    text = lambda v: " ".join("".join(rng.choice(letters[v]) for _ in range(5)) for _ in range(30))
    langs = [v for v in letters for _ in range(12)]
    model = language_id.CodedClassifier.fit([text(v) for v in langs], langs)
    tried = [text(v) for v in letters] + ["Some other words", "ÀÉ漢字 ok", "x", "abc" * 1000]
    for t, (lang, score, _) in zip(tried, model.decode(tried), strict=True):
        codes = [*(ord(c) for c in t.lower()), 0, 0]
        plain = [c if c >= 128 or chr(c).isalpha() or c == 0 else 32 for c in codes]
        margins = np.array(model.bias, float)
        for order in language_id.ORDERS:
            buckets = language_id._buckets(np.array(plain, np.uint32), order)[: len(t.lower())]
            margins = margins + sum(model.weights[b].astype(float) for b in buckets) / (3 * len(t.lower()))
        losses = [sum(w * np.log1p(np.exp(-c * m)) for w, c, m in zip(model.trust[k], model.code[k], margins, strict=True)) for k in range(len(model.langs))]
        assert lang == model.langs[int(np.argmin(losses))]
        assert score == pytest.approx(np.exp(-min(losses)), abs=1e-4)
    assert [v for v, _, _ in model.decode([text(v) for v in letters])] == list(letters)


def test_language_of_long_texts_is_that_of_their_parts(monkeypatch):
    rng = random.Random(5)
    texts = [words(rng, 300), "ab", "", "é" * 7, words(rng, 40)]
    weights = np.random.default_rng(1).standard_normal((1 << language_id.BUCKET_BITS, 3))
    whole = language_id.margins_of(texts, weights)
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 64)
    assert np.allclose(language_id.margins_of(texts, weights), whole)
    assert np.allclose(language_id.margins_of(texts[::-1], weights)[::-1], whole)


def test_language_knows_as_many_languages_as_there_are():
    langs = [f"l{k}" for k in range(70) for _ in range(3)]
    texts = [f"{chr(0x4E00 + 50 * int(v[1:]))}{chr(0x4E01 + 50 * int(v[1:]))} " * 20 for v in langs]
    model = language_id.CodedClassifier.fit(texts, langs)
    assert len(model.langs) == 70
    assert np.mean([lang == v for (lang, _, _), v in zip(model.decode(texts), langs, strict=True)]) > 0.9


def test_language_of_odd_texts(spark):
    got = language_id.identify(frame(spark)).collect()
    assert len(got) == len(rows())
    assert {r.lang_pred for r in got if not any(map(str.isalpha, r.text or ""))} == {"und"}
    assert {r.lang_pred for r in got if any(map(str.isalpha, r.text or ""))} <= {"en", "de"}
    assert language_id.identify(spark.createDataFrame([], COLUMNS)).count() == 0


def test_toxic_words_are_found_wherever_they_stand():
    rng = random.Random(4)
    texts = [words(rng, rng.randint(5, 90)) for _ in range(460)]
    toxic = [k % 3 == 0 for k in range(len(texts))]
    for k, t in enumerate(texts):
        if toxic[k]:
            w = t.split()
            w.insert(rng.randrange(len(w) + 1), "zqx" + words(rng, 1))
            texts[k] = " ".join(w)
    network = toxicity.Network().fit(texts[:400], [int(t) for t in toxic[:400]], 1 / 3)
    scores = toxicity.Scorer(network).score([*texts[400:], "", "word " * 20_000, words(rng, 60_000) + " zqxabc"])
    assert np.mean((scores[:60] >= 0.3) == np.array(toxic[400:])) > 0.8
    assert np.isfinite(scores).all() and scores[-1] >= 0.3


def _plain_score(network: toxicity.Network, text: str) -> float:
    """Both recurrent passes and the pooling of each window, word by word; the worst window counts."""
    p, h = network.p, toxicity.HIDDEN
    words = toxicity.words_of(text)
    inputs = {w: network.vectors([w])[0][0].astype(float) for w in set(words)}
    gate = {(w, way): x @ p["inputs"][way] + p["offset"][way, 0] for w, x in inputs.items() for way in (0, 1)}
    squash = lambda x: 1 / (1 + np.exp(-x))
    worst = -np.inf
    for start in range(0, max(1, len(words) - toxicity.LENGTH + toxicity.STRIDE), toxicity.STRIDE):
        part = words[start : start + toxicity.LENGTH]
        states = []
        for way, line in ((0, part), (1, part[::-1])):
            state, passed = np.zeros(h), []
            for w in line:
                x, u = gate[w, way], state @ p["state"][way]
                z, r = squash(x[:h] + u[:h]), squash(x[h : 2 * h] + u[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :])
                passed.append(state)
            states.append(passed if way == 0 else passed[::-1])
        seen = np.array([np.concatenate(pair) for pair in zip(*states, strict=True)])
        share = np.exp(seen @ p["look"] - (seen @ p["look"]).max())
        worst = max(worst, float((share / share.sum()) @ seen @ p["out"] + p["bias"][0]))
    return float(squash(worst))


def test_toxicity_scores_equal_a_plain_network(monkeypatch):
    rng = np.random.default_rng(12)
    network = toxicity.Network(seed=4)
    for name in ("words", "chars"):
        network.p[name] *= 20  # states far from 0
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k] for k in rng.integers(0, 400, n)) for n in (1, 2, 47, 48, 49, 72, 73, 500, 20_000)]
    scores = toxicity.Scorer(network).score(texts)
    assert np.allclose(scores, [_plain_score(network, t) for t in texts], atol=2e-4) and np.ptp(scores) > 0.05
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 700)  # long texts go in many parts
    assert np.allclose(toxicity.Scorer(network).score(texts), scores, atol=1e-5)


def test_toxicity_of_held_out_documents(spark, sf_dir):
    larger = Path(sf_dir).parent / "sf0.01"
    if not larger.exists():
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op8_toxicity(spark, str(larger)).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.6
    assert np.mean([r.predicted for r in got if not r.toxic]) < 0.1


def test_toxicity_reads_long_words_to_their_end():
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh.,") for _ in range(1000))
    pieces = toxicity.words_of(f"It, {long} ends.")
    assert pieces[0] == "it" and pieces[-1] == "ends" and max(map(len, pieces)) <= toxicity.WORD_CHARS
    plain, order = long.strip(toxicity.EDGES), max(toxicity.CHAR_ORDERS)
    assert all(any(plain[k : k + order] in p for p in pieces) for k in range(len(plain) - order + 1))
    assert toxicity.words_of("x" * toxicity.WORD_CHARS) == ["x" * toxicity.WORD_CHARS]
    assert toxicity.words_of("No no NO no!") == ["no"] * 4
    network = toxicity.Network()
    network.p["chars"][:] = np.random.default_rng(1).standard_normal(network.p["chars"].shape)
    prefix, other = long[:200], long[:200].replace("a", "z")
    scores = toxicity.Scorer(network).score([prefix + "z" * 40, prefix + "zqxabc" * 20, other + "z" * 40])
    assert len(set(scores)) == 3


def test_toxicity_gradients():
    network = toxicity.Network(3)
    names = ["\x00", *words(random.Random(1), 30).split()]
    ids = np.zeros((3, toxicity.LENGTH), np.int64)
    for k, n in enumerate((48, 20, 1)):
        ids[k, :n] = np.random.default_rng(k).integers(1, len(names), n)
    for k, v in network.p.items():
        network.p[k] = v.astype(np.float64)
    gates = network.vectors(names)[0] @ network.p["inputs"] + network.p["offset"]
    d = np.array([0.3, -0.7, 1.1])
    g, _ = network.backward(network.forward(gates, ids, keep=True)[1], d, len(names))
    for name in ("state", "look", "out", "bias"):
        flat = network.p[name].ravel()
        for at in (0, len(flat) // 2, len(flat) - 1):
            before, h = flat[at], 1e-2
            flat[at] = before + h
            up = network.forward(gates, ids) @ d
            flat[at] = before - h
            down = network.forward(gates, ids) @ d
            flat[at] = before
            assert (up - down) / (2 * h) == pytest.approx(np.asarray(g[name]).ravel()[at], rel=0.05, abs=2e-3)


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame(spark), labels)
    got = toxicity.toxicity(frame(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.toxic_score <= 1 for r in got)
    assert toxicity.toxicity(spark.createDataFrame([], COLUMNS), model).count() == 0


def test_pii_kinds_places_and_masks(spark):
    cases = [
        (1, "mail me: a.b@c.d.org, or a@b..c; a@b"), (2, "ip 1.2.3.4 and 1.2.3.256 and 1.2.3.4.5.6.7.8"),
        (3, "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 4111  1111"), (4, "😀 call +1 (212) 555-0100 now"),
        (5, "iban GB82WEST12345698765432 and GB82WEST12345698765431"), (6, None), (7, ""), (8, "1 2 " * 30_000), (9, "a@" + "b." * 20_000 + "c"),
        (10, "x" * 200_000), (11, "@@.. +1 +"),
    ]
    found = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.pii] for r in pii_spans(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert found[1] == [("email", 9, 20)]
    assert found[2] == [("ip", 3, 10), ("ip", 29, 36), ("ip", 37, 44)]
    assert found[3] == [("card", 5, 24)]
    assert found[4] == [("phone", 7, 24)]
    assert found[5] == [("iban", 5, 27)]
    assert all(found[k] == [] for k in (6, 7, 8, 10, 11)) and found[9] == [("email", 0, 40_003)]
    text = {r.doc_id: r.text for r in masked(spark.createDataFrame(cases[:7], "doc_id long, text string")).collect()}
    assert text[4] == "😀 call <PHONE> now" and text[6] is None
    assert text[2] == "ip <IP> and 1.2.3.256 and <IP>.<IP>"
    assert masked(frame(spark)).columns == frame(spark).columns
    assert len(KINDS) == 5


def test_pii_of_long_texts_full_of_digits(spark):
    """Each of these texts took minutes or never ended when places were summed up one after the other."""
    n = 20_000
    cases = [(1, "12x" * 300_000), (2, "4111 1111 1111 1111, " * n), (3, "a@b.org " * n), (4, "x" * 5000 + " 1.2.3.4 " + "é" * 5000 + " call +1 (212) 555-0100")]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    began = time.monotonic()
    found = {r.doc_id: r.pii for r in pii_spans(docs).collect()}
    hidden = {r.doc_id: r.text for r in masked(docs).collect()}
    assert time.monotonic() - began < 120
    assert found[1] == [] and hidden[1] == cases[0][1]
    assert [(s.start, s.end) for s in found[2]] == [(21 * k, 21 * k + 19) for k in range(n)] and hidden[2] == "<CARD>, " * n
    assert [(s.start, s.end) for s in found[3]] == [(8 * k, 8 * k + 7) for k in range(n)] and hidden[3] == "<EMAIL> " * n
    assert hidden[4] == "x" * 5000 + " <IP> " + "é" * 5000 + " call <PHONE>"
    assert [(s.kind, s.start, s.end, round(s.score, 1)) for s in found[4]] == [("ip", 5001, 5008, 0.5), ("phone", 10_015, 10_032, 0.8)]


def test_pii_query_works_out_the_context_scores(spark, sf_dir):
    got = op6_pii(spark, sf_dir)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all(pattern in plan for pattern in CONTEXT.values())
    found = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii] for r in pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r in got.collect():
        assert r.spans == ",".join(found[r.doc_id]) and all(r[f"n_{k}"] == sum(s.startswith(f"{k}:") for s in found[r.doc_id]) for k in KINDS)


def test_packing_is_whole_and_gapless(spark):
    found = rows() + [(900, "<|endoftext|> a<|startoftext|>b c\x1cd It's 42"), (901, words(random.Random(9), 3000))]
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.pack(frame(spark, found), WORDS, 256).collect()
    expected = []
    for i, t in found:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, p, at, min(256, len(ids) - at), zlib.crc32(ids[at : at + 256].tobytes())) for p, at in enumerate(range(0, len(ids), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 256
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 256 + 1
    assert packing.pack(spark.createDataFrame([], COLUMNS), WORDS).count() == 0


def _sequences(leaves: list[list[int]], capacity: int, carried: int | None) -> int:
    """Bins of a tree of nodes with these lengths, each passing on its `carried` emptiest underfull bins (None: all)."""
    nodes, done = [packing.best_fit(x, capacity)[1] for x in leaves], 0
    while len(nodes) > 1:
        above = []
        for lo in range(0, len(nodes), packing.FAN_IN):
            items: list[int] = []
            for loads in nodes[lo : lo + packing.FAN_IN]:
                open_ = sorted(x for x in loads if x < int(packing.NEARLY_FULL * capacity))
                done += len(loads) - len(open_[:carried])
                items += open_[:carried]
            above.append(packing.best_fit(items, capacity)[1])
        nodes = above
    return done + len(nodes[0])


def test_a_full_memo_keeps_its_first_words_and_stays_small(monkeypatch):
    t, most = tokens.WordTokens(WORDS), tokens.MEMO_WORDS
    monkeypatch.setattr(tokens, "MEMO_WORDS", 2000)
    monkeypatch.setattr(tokens, "STAYING_WORDS", 1000, raising=False)
    for k in range(12):
        texts = [" ".join(["frequent", "Words,", *(f"w{k}x{n}y{i}" for i in range(30))]) for n in range(20)]
        assert t.ids(texts) == [t.whole(x) for x in texts]
        assert len(t.memo) <= 2000 and "frequent" in t.memo and "words," in t.memo
    each = (sys.getsizeof(t.memo) + sum(sys.getsizeof(x) for kv in t.memo.items() for x in kv)) / len(t.memo)
    assert each * most < 128e6


def test_nodes_pass_on_all_that_is_of_use():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([64, 256, 1024])
        low, high = sorted(rng.randint(1, capacity) for _ in "ab")
        leaves = [[rng.randint(low, high) for _ in range(rng.randint(1, 60))] for _ in range(rng.choice([3, 17, 40, 300]))]
        assert _sequences(leaves, capacity, packing.FAN_IN + 1) == _sequences(leaves, capacity, None)


def _best(model, text):
    """Plain Viterbi over a whole escaped text."""
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        single = False
        for n in range(1, min(model.longest, len(text) - i) + 1):
            hit = model.scores.get(text[i : i + n])
            if hit:
                single = single or n == 1
                if best[i] + hit[0] > best[i + n]:
                    best[i + n], back[i + n] = best[i] + hit[0], (i, [hit[1]])
        if not single and best[i] + model.unknown_score > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + model.unknown_score, (i, [model.byte_ids[b] for b in text[i].encode()])
    ids, at = [], len(text)
    while at:
        at, piece = back[at]
        ids = piece + ids
    return ids


def test_pieces_equal_plain_viterbi_and_come_back():
    model = pieces.model(PIECES)
    texts = ["the theaatble", "a  b   c ", " lead", "line\nnext\ttab", "é ü 😀 漢字", "x" * 300, "    " * 20, words(random.Random(2), 200)]
    for text in texts:
        escaped = (" " + text).replace(" ", pieces.SPACE)
        ids = np.frombuffer(model.encode(text), "<u4").tolist()
        assert ids == _best(model, escaped), text
        assert [i for run in model.stream(iter(escaped)) for i in run] == ids
        assert model.decode(ids) == text
    assert model.encode(None) == model.encode("") == b""


def test_pieces_of_documents(spark):
    got = pieces.encode(frame(spark), PIECES)
    found = got.collect()
    assert len(found) == len(rows()) and all(r.round_trip and r.n_ids == len(r.ids) for r in found)
    back = {(r.doc_id, r.text) for r in pieces.decode(got, PIECES).collect()}
    assert back == {(i, t or "") for i, t in rows()}
    assert pieces.encode(spark.createDataFrame([], COLUMNS), PIECES).count() == 0
