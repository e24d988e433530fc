"""Fingerprints, tokens, extraction, chat, selection and languages."""

import hashlib
import os
import random
import re

import duckdb
import layouts
import numpy as np
import pytest
from pyspark.sql import functions as F

from epilattice.llm import chat, extract, fingerprint, html_blocks, language, queries, resample
from epilattice.llm.sentencepiece_fst import Transducer, decode, encode

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
vocabulary = pytest.mark.skipif(not os.path.exists(queries.VOCABULARY), reason="needs the public vocabulary")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int")


def test_prefix_hashes():
    a, b = fingerprint.PrefixHashes.of("abcdeféghij🙂klm"), fingerprint.PrefixHashes.of("xxcdeféghij🙂zz")
    assert a.equal(2, b, 2, 9) and not a.equal(1, b, 1, 3) and not a.equal(0, b, 0, 100)
    assert a.extension(2, b, 2) == len("cdeféghij🙂") and a.extension(0, b, 0) == 0
    text = "ab" * 5000
    p = fingerprint.PrefixHashes.of(text)
    assert p.extension(0, p, 2) == len(text) - 2 and p.extension(0, p, 1) == 0


def test_fingerprints(spark):
    r = random.Random(1)
    rows = [(i * 3 % 101, "".join(r.choice("abc é🙂") for _ in range(r.choice([0, 1, 2, 50, 3000])))) for i in range(60)] + [(200, None), (201, "z" * 200_000)]
    got = {x.doc_id: x for x in fingerprint.fingerprints(docs(spark, rows), 7).collect()}
    order = sorted(rows)
    prints = {}
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 and x.fingerprint == fingerprint.PrefixHashes.of(t).fingerprint()
        assert x.edited_fingerprint == fingerprint.PrefixHashes.of(changed).fingerprint()
        assert prints.setdefault(x.fingerprint, t) == t
        if len(t) >= 3000 and len(follow) >= 3000:
            assert 0.45 <= x.near_edited <= 0.6 and x.near_next < 0.1
    assert len(got) == len(rows)


def test_likeness_at_any_place():
    """Insertions, deletions and moves cost about what they change, however early they come."""
    r = random.Random(21)
    text = "".join(r.choice("abcdefghij klmnop") for _ in range(6000))
    other = "".join(r.choice("abcdefghij klmnop") for _ in range(6000))
    like = lambda a, b: fingerprint.likeness(*(fingerprint.PrefixHashes.of(x).fingerprint() for x in (a, b)))
    assert like(text, text) == 1 and like(text, other) == 0 and like(text, "") == 0 and like("", "") == 1
    assert like(text, "x" + text) > 0.88 and like(text, text[:50] + "inserted" + text[50:]) > 0.88 and like(text, text[100:]) > 0.88
    assert 0.58 < like(text, other[:3000] + text) < 0.67 and 0.4 < like(text, text[:3000] + other[:3000]) < 0.56 and 0.4 < like(text, text[3000:] + text[:3000]) < 0.6
    assert like("ab" * 2000, "ab" * 1500) > 0.6 and like(text[:40], text[:40] + "z") > 0.4
    a = fingerprint.Blocks(fingerprint.PrefixHashes.of("q" + text).fingerprint())
    for i, j in [(0, 1), (2, 9), (5, 6)]:  # spans are told by their text, not their place
        own = ("q" + text)[a.at[i] : a.at[j]]
        assert fingerprint.Blocks(fingerprint.PrefixHashes.of(own).fingerprint()).span(0, -1) == a.span(i, j)
    assert a.steps == [a.span(k, k + 1) for k in range(len(a.steps))]


def test_fingerprints_of_awkward_tables(spark):
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0
    one = fingerprint.fingerprints(docs(spark, [(None, "abcd")])).first()
    assert one.near_edited < 1 and one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = fingerprint.fingerprints(docs(spark, [(1, "aa"), (1, "aa"), (1, "bb"), (None, "cc"), (None, None)]), 4).collect()
    assert len(rows) == 5 and sum(x.near_next == 1 for x in rows) == 1
    assert fingerprint.likeness(*(fingerprint.PrefixHashes.of(x).fingerprint() for x in ("x" * 999, "x" * 700))) == pytest.approx(0.7, abs=0.07)


@vocabulary
def test_tokens_equal_the_public_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    r = random.Random(2)
    texts = ["", " ", "  a  b ", "Hello, world!\n\tnext", "naïve café 🙂 日本語", "<s>x</s> <0x41>", "\x00", "ſtraße" * 50, "a" * 5000, "word " * 20000]
    texts += ["".join(r.choice("the inga é\n🙂.,▁ bc(){};\r") for _ in range(r.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    got = decode(encode(rows, queries.VOCABULARY), queries.VOCABULARY)
    assert got.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    for x in got.collect():
        if x.text is None:
            assert (x.n_tokens, x.token_ids, x.decoded) == (0, None, None)
        else:
            assert x.token_ids == sp.encode(x.text) and x.n_tokens == len(x.token_ids)
            assert x.decoded == x.text.replace("▁", " ")
    assert encode(rows.where("false"), queries.VOCABULARY).count() == 0


def test_unigram_models_equal_the_public_library(spark, tmp_path):
    """A unigram model put together by hand: the least path, and by brute force the least weight."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    r, model = random.Random(12), pb.ModelProto()
    add = lambda piece, score, kind: model.pieces.add(piece=piece, score=score, type=kind)
    kinds = pb.ModelProto.SentencePiece
    add("<unk>", 0, kinds.UNKNOWN)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, kinds.BYTE)
    own = {"▁", "a", "b", "c", "é"} | {"".join(r.choice("▁abcé") if k == 0 else r.choice("abcé") for k in range(r.randint(2, 5))) for _ in range(60)} | {"xy"}
    for p in sorted(own):
        add(p, -r.uniform(1, 9), kinds.NORMAL)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = pb.TrainerSpec.UNIGRAM, True
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(r.choice("abcé abcé\n🙂xyz") for _ in range(r.randrange(40))) for _ in range(300)] + ["", " ", "  a", "abc" * 2000, None]
    got = decode(encode(spark.createDataFrame([(t,) for t in texts], "text string"), str(path)), str(path)).collect()
    for x in got:
        if x.text is not None:
            assert x.token_ids == sp.encode(x.text) and x.decoded == x.text
    t = Transducer(str(path))
    for text in filter(None, texts[:60]):
        chars = " " + text
        best = [0.0] + [float("inf")] * len(chars)
        for j in range(1, len(chars) + 1):
            for i in range(max(0, j - 6), j):
                p = chars[i:j].replace(" ", "▁")
                w = -t.scores[p] if p in t.scores else t.fallback if j == i + 1 else float("inf")
                best[j] = min(best[j], best[i] + w)
        ids = sp.encode(text)
        raw = bytes(x - 1 for x in ids if 1 <= x <= 256).decode()  # of characters without a piece
        total = len(raw) * t.fallback + sum(t.weights[x] for x in ids if x > 256)
        assert total == pytest.approx(best[-1], rel=1e-6)


@vocabulary
def test_whole_table_round_trip(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    out = queries.op4_sentencepiece(spark, SF)
    assert out.where("NOT round_trip").count() == 0 and out.count() > 0


def test_blocks():
    html = (
        "<!DOCTYPE html><title>no</title><script>var x='</p>';</script><!-- <p>no</p> --><nav class='Top-Menu'><li><a href=\"/a>b\">x</a><li>y</nav>"
        "<article><h1>A &amp;  B</h1><p><b>one<br>two<p>three &eacute;&nbsp;&#x1F642; <i>x</i>y</p> tail </article><p>end < here"
    )
    got = html_blocks.blocks(html)
    assert [t for _, t in got] == ["x", "y", "A & B", "one two", "three é 🙂 xy", "tail", "end < here"]
    assert got[0][0][0] == ("nav", "class:top", "class:menu") and [e[0] for e in got[5][0]] == ["article"]
    assert html_blocks.blocks(None) == [] and html_blocks.blocks("") == [] and [t for _, t in html_blocks.blocks("plain")] == ["plain"]
    assert len(html_blocks.blocks("<div>" * 20000 + "deep")) == 1 and html_blocks.blocks("<" * 5000) and html_blocks.blocks("<a '" * 3000) is not None


def test_blocks_lose_no_text_around_raw_elements():
    texts = lambda html: [t for _, t in html_blocks.blocks(html)]
    for tag in ('<svg-icon name="x"></svg-icon>', "<template-x></template-x>", '<svg class="i"/>', "<svg>", "<template>", "<svg><text>no</text></svg>", "<title-bar/>", "<iframe>"):
        assert texts(f"<p>one</p>{tag}<p>two</p>") == ["one", "two"], tag
    for tag in ("math", "object", "noscript", "canvas"):
        assert texts(f"<article><p>one <{tag}>in</{tag}> two</p></article>") == ["one in two"], tag
    assert html_blocks.blocks("<math/><p>x</p>") == [((("p",),), "x")]
    assert texts("<p>one</p><script>no<p>no") == ["one"] and texts("<p>one<style/>no</p>") == ["one"]
    assert texts("<svg>" * 50000 + "<p>x</p>") == ["x"]


@tables
def test_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = extract.train(pages)
    out = extract.extract(pages.withColumn("text", F.lit("old")), model).collect()
    assert len(out) == pages.count()
    for x in out:
        found = html_blocks.blocks(x.html)
        want = [t for p, t in found if any(e[0] == "article" for e in p)]
        assert x.text.split("\n") == want and x.n_chars == len(x.text)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p>")], "page_id long, html string")
    assert [x.text for x in extract.extract(odd, model).collect()] == ["", "", ""]
    assert extract.extract(odd.where("false"), model).count() == 0
    # sites of other templates than those that training composes: whole pages, exactly
    r, right = random.Random(77), 0
    sites = [(k, *layouts.page(r, k)) for k in range(200)]
    rows = spark.createDataFrame([(k, html) for k, html, _ in sites], "page_id int, html string")
    got = {x.page_id: x.text for x in extract.extract(rows, model).collect()}
    assert sum(got[k] == "\n".join(main) for k, _, main in sites) >= 0.97 * len(sites)
    for html, want in {
        '<div class="col-8"><h1>A title here</h1><p>A first paragraph with some words in it.</p><p>And a second one, which is long enough.</p></div>': 3,
        '<table><tr><td><a href=x>Home</a></td><td><p>A first paragraph with some words in it.</p><p>And a second one, which is long enough.</p></td></tr></table>': 2,
        '<article><p>One short.</p><div class="comments"><p>I disagree with this.</p></div><p>Two short.</p></article>': 2,
        "<main><h1>Title</h1><p>A long paragraph with a number of words in it.</p><p>Short end.</p></main>": 3,
    }.items():
        out = extract.extract(spark.createDataFrame([(html,)], "html string"), model).first().text
        assert len(out.split("\n")) == want and "disagree" not in out and "Home" not in out


@tables
def test_training_does_not_depend_on_order(spark, monkeypatch):
    """Nor on copies: the same sample, and so the same weights."""
    monkeypatch.setattr(extract, "STEPS", 3)
    monkeypatch.setattr(extract, "COMPOSED", 5)
    monkeypatch.setattr(extract.Labeller, "fit", lambda self, pages: [p[0].sum() for p in pages])
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html")
    one = extract.train(pages, 20)
    assert extract.train(pages.orderBy(F.desc("html")).union(pages.limit(5)).repartition(3), 20) == one and len(one) >= 5


def test_labeller_gradients():
    r = np.random.default_rng(0)
    m = extract.Labeller(5)
    x, mask, y = extract.padded([(r.normal(size=(4, 5)).astype(np.float32), np.array([1, 0, 1, 1])), (r.normal(size=(2, 5)).astype(np.float32), np.array([0, 1]))])
    loss = lambda: float(np.sum((np.logaddexp(0, m.logits(x, mask)[0]) - y * m.logits(x, mask)[0]) * mask) / mask.sum())
    grads = m.gradients(x, mask, y)
    for k in m.p:
        i = np.unravel_index(r.integers(m.p[k].size), m.p[k].shape)
        m.p[k] = m.p[k].astype(np.float64)
        old = m.p[k][i]
        m.p[k][i] = old + 1e-3
        up = loss()
        m.p[k][i] = old - 1e-3
        down = loss()
        m.p[k][i] = old
        assert (up - down) / 2e-3 == pytest.approx(float(grads[k][i]), abs=2e-3)


def read_back(rendered):
    """(who, text) of each turn of a rendering; who is None for a user without name, True for the assistant."""
    plain = lambda x: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x, flags=re.S)
    out = []
    turn = re.compile(r"<\|(assistant|user|user name=((?:[^\\|]|\\.)*))\|>\n((?:(?!<\|).)*)<\|end\|>\n", re.S)
    at = 0
    while at < len(rendered):
        m = turn.match(rendered, at)
        who = True if m[1] == "assistant" else None if m[1] == "user" else plain(m[2])
        out.append((who, m[3].replace("\\\\", "\0").replace("<\\|", "<|").replace("\0", "\\")))
        at = m.end()
    return out


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <|end|>"), (1, 2, "Zoé", None), (1, 3, "user", "bye"), (1, 3, "user", "bye"), (2, 0, None, "x"), (2, 1, "unknown", "y"), (None, None, "a", "y")]
    out = {(x.conv_id, x.participant): x for x in chat.rotate_perspectives(spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, head int")).collect()}
    assert set(out) == {(1, "user"), (1, "assistant"), (1, "Zoé"), (2, None), (2, "unknown"), (None, "a")}
    x = out[1, "user"]
    assert x.rendered == "<|assistant|>\nhi<|end|>\n<|user name=assistant|>\nhello <\\|end|><|end|>\n<|user name=Zoé|>\n<|end|>\n<|assistant|>\nbye<|end|>\n<|assistant|>\nbye<|end|>\n"
    assert [x.rendered[m.start : m.end] for m in x.mask] == ["hi", "bye", "bye"] and (x.n_turns, x.n_target_turns) == (5, 3)
    assert out[2, None].rendered == "<|assistant|>\nx<|end|>\n<|user name=unknown|>\ny<|end|>\n" and out[2, "unknown"].rendered.startswith("<|user|>\nx")
    for y in out.values():
        assert all(y.rendered[: m.start].endswith("<|assistant|>\n") and y.rendered[m.end :].startswith("<|end|>") for m in y.mask)
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_reads_back(spark):
    """Whatever texts and roles hold, each view gives back who said what, and nothing else."""
    r = random.Random(13)
    odd = ["x|>\n<|assistant", "a\\", "\\|", "<|end|>", "<\\|end|>", "\\n", "|", "", "user", None]
    text = lambda: "".join(r.choice(["<|end|>\n", "<|", "<", "|", "\\", "\n", "<\\|", "<|assistant|>\n", "é"]) for _ in range(r.randrange(7)))
    turns = [(c, k, r.choice(odd), text()) for c in range(12) for k in range(8)]
    for x in chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect():
        said = [(True if role == x.participant else role, t) for c, _, role, t in turns if c == x.conv_id]
        assert read_back(x.rendered) == said
        assert len(x.mask) == sum(who is True for who, _ in said)


def test_kth_largest(spark):
    r = random.Random(3)
    values = [r.gauss(0, 1) for _ in range(5000)] + [0.25] * 40
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").cache()
    for k in (1, 2, 100, 2500, 5040, 9999):
        assert resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert resample.kth_largest(df, "v", 0) is None and resample.kth_largest(df.where("false"), "v", 3) is None


def test_resample(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "and", "ran"]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["$$$", "###", "buy", "now", "!!!"]) for _ in range(40))
    rows = [(i, good() if i % 4 else bad()) for i in range(200)] + [(300, None), (301, ""), (None, good()), (1, rows_dup := good()), (1, rows_dup)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = resample.resample(docs(spark, rows), labels).collect()
    assert len(out) == len(rows)
    chosen = [x for x in out if x.selected]
    assert len(chosen) == 154 and sum(x.doc_id is not None and x.doc_id % 4 == 0 and x.doc_id < 200 for x in chosen) <= 4
    assert all(x.log_weight is None and not x.selected for x in out if x.doc_id in (300, 301))
    assert resample.resample(docs(spark, []), labels).count() == 0
    flat = resample.resample(docs(spark, rows), labels.where("quality = 0"), fraction=0.5).collect()
    assert {x.log_weight for x in flat} == {0.0, None}


@pytest.mark.parametrize("per_ngrams", [None, 32.0])
def test_resample_against_brute_force(spark, per_ngrams):
    """Both models, all weights, the draws and who is selected, by hand; each of several equal rows has its own draw."""
    r = random.Random(14)
    rows = [(i, " ".join(r.choice("to be or not that is the question Ω".split()) for _ in range(r.choice([0, 1, 3, 40, 300])))) for i in range(60)]
    rows += [(3, rows[3][1])] * 6 + [(None, "to be")] * 3 + [(61, None)]
    labels = [(i, int(i % 3 == 0), 0) for i in range(30)] + [(1, 1, 1), (3, 0, 0)]
    out = resample.resample(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), seed=5, per_ngrams=per_ngrams)
    good = {i for i, q, _ in labels if q == 1}

    def grams(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return resample.features(raw, np.array([0, len(raw)]))[0].tolist()

    raw, target = np.ones(1 << resample.BUCKETS), np.ones(1 << resample.BUCKETS)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want, seen = [], {}
    for i, t in rows:
        own = grams(t)
        seen[i, t] = seen.get((i, t), -1) + 1
        h = spark.range(1).select(F.xxhash64(F.lit(5), F.lit(i).cast("long"), F.xxhash64(F.lit(t).cast("string")), F.lit(seen[i, t]).cast("long"))).first()[0]
        draw = -np.log(-np.log(((h % 2**64 >> 11) + 0.5) / 2**53))
        w = ratio[own].sum() * (per_ngrams / len(own) if per_ngrams and own else 1) if own else None
        want.append((i, w, None if w is None else w + draw))
    scores = sorted((x for _, _, x in want if x is not None), reverse=True)
    last = scores[round(len(rows) * len(good) / 30) - 1]
    plain = lambda rows: sorted((str(i), *(f"{x:.6f}" if x is not None else "none" for x in (w, g)), c) for i, w, g, c in rows)
    assert plain(map(tuple, out.collect())) == plain((i, w, g, g is not None and g >= last) for i, w, g in want)


@tables
def test_language(spark):
    out = queries.op10_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() / held.count() > 0.98
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_cases(spark):
    rows = [("das ist ein haus und der hund", "de")] * 5 + [("the dog is in the house and", "en")] * 5 + [(None, "en"), ("x", None)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(1, "der hund ist ein hund"), (2, "the house of the dog"), (3, None), (4, ""), (5, "123 … — !"), (6, "日本語"), (7, "the dog " * 20000)]
    out = {x.doc_id: x for x in language.identify(spark.createDataFrame([(i, t, 3) for i, t in asked], "doc_id long, text string, score int"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["de", "en", "und", "und", "und", "en"]
    assert out[3].score == 0 and out[6].lang_pred in ("de", "en") and out[6].score == 0
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert language.identify(docs(spark, [(1, "abc")]), none).first().lang_pred == "und"
    kept = language.keep_known(spark.createDataFrame([(i, t, g, "s") for i, (t, g) in enumerate(rows)] + [(90, "42", "en", "s")], "doc_id long, text string, lang string, row string"))
    assert kept.columns == ["doc_id", "text", "lang", "row"] and kept.count() == 11


def grams_of(text):
    """All n-grams with a letter in the middle, by a walk over the bytes."""
    pad = [32] * (language.NGRAM - 1)
    own = [*pad, *(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()), *pad]
    return [tuple(own[i : i + language.NGRAM]) for i in range(len(own) - language.NGRAM + 1) if own[i + language.NGRAM // 2] != 32]


def test_language_filter_against_brute_force(spark, monkeypatch):
    """Counts, members, masks and corrected scores of seventy languages, against dictionaries and a filter by hand."""
    r = random.Random(11)
    spoken = {f"l{k:02}": ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(9)] for k in range(70)}
    rows = [(" ".join(r.choice(own) for _ in range(25)).title(), lang) for lang, own in spoken.items() for _ in range(4)]
    monkeypatch.setattr(language, "GATHERED", 300)  # handed on in many parts
    languages, members = language.language_members(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    counts = {lang: {} for lang in spoken}
    for text, lang in rows:
        for g in grams_of(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    rate = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()}
    code = lambda g: int(language.hashed(np.array([0]), np.array([5]), language.prefix(np.array(g, np.uint64), language.BASES[0]), language.BASES[0])[0])
    want = {}
    for k, lang in enumerate(sorted(spoken)):
        for g, n in counts[lang].items():
            if rate[lang][g] >= 0.5 * max(x.get(g, 0) for x in rate.values()):
                want.setdefault(code(g), [0, 0])[k // 64] |= 1 << k % 64
    got = {x.h % 2**64: [m % 2**64 for m in x.masks] for x in members.collect()}
    assert languages == sorted(spoken) and got == want
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = np.array([*want, *(r.getrandbits(64) for _ in range(20000))], np.uint64)
    packed = lambda grams, model: sum(language.masks_of(model.slice(i), grams, model.bits, i) for i in range(model.slices))
    masks = packed(asked, model)
    plain = np.array([[x >> 8 * b & 255 for x in w for b in range(8)] for w in want.values()], np.uint8)[:, : model.width]
    assert (masks[: len(want)] & plain == plain).all()  # none is lost
    for k in (0, 33, 69):  # false positives come at the rate that is taken off
        assert language._bit(masks[len(want) :], k).mean() == pytest.approx(model.false_rate[k], abs=0.005)
    text = rows[0][0]
    hits = [language._bit(packed(np.array([code(g) for g in grams_of(text)], np.uint64), model), k).mean() for k in range(70)]
    scores = [max(0, (h - f) / (1 - f)) for h, f in zip(hits, model.false_rate)]
    out = language.identify(spark.createDataFrame([(text,)], "text string"), model).first()
    assert out.lang_pred == languages[int(np.argmax(scores))] and out.score == pytest.approx(max(scores))


def test_language_of_one_text_is_learned(spark):
    """A language with a single text, whose n-grams come once each, is predicted all the same."""
    rows = [(f"the dog {i} is in the house and the garden of number {i}", "en") for i in range(300)] + [("kissa istuu ikkunalla", "fi")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    out = language.identify(spark.createDataFrame([("kissa ikkunalla",), ("the garden",)], "text string"), model).collect()
    assert [x.lang_pred for x in out] == ["fi", "en"]


def test_language_filter_in_slices(spark, monkeypatch):
    """A filter too large for one slice is asked in several passes, with the same members and fitting answers."""
    r = random.Random(5)
    spoken = {lang: ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(40)] for lang, letters in (("a", "abcdefghé"), ("b", "fghijklmü"), ("c", "acegikmoø"))}
    rows = [(" ".join(r.choice(own) for _ in range(30)), lang) for lang, own in spoken.items() for _ in range(20)]
    training = spark.createDataFrame(rows, "text string, lang string")
    asked = spark.createDataFrame([(i, t, "kept") for i, (t, _) in enumerate(rows)] + [(900, None, "kept"), (901, "42", "kept"), (902, "", None)], "doc_id long, text string, _hits string")
    whole = language.fit(training)
    monkeypatch.setattr(language, "SLICE_BYTES", 2048)
    monkeypatch.setattr(language, "BLOCK_BITS", 8)
    cut = language.fit(training)
    assert whole.slices == 1 and cut.slices > 2 and cut.bits == whole.bits
    assert sum(cut.slice(i).any(axis=1).sum() for i in range(cut.slices)) == pytest.approx(whole.slice(0).any(axis=1).sum(), rel=0.05)
    out = language.identify(asked, cut)
    assert out.columns == ["doc_id", "text", "_hits", "lang_pred", "score"]
    own, other = ({x.doc_id: x for x in df.collect()} for df in (out, language.identify(asked, whole)))
    assert len(own) == len(rows) + 3 and all(own[i].lang_pred == lang for i, (_, lang) in enumerate(rows))
    assert all(own[i].lang_pred == x.lang_pred and own[i]._hits == x._hits and own[i].score == pytest.approx(x.score, abs=0.05) for i, x in other.items())
    named = asked.withColumn("lang", F.lit("a"))
    assert language.keep_known(named).columns == named.columns and language.keep_known(named).count() == len(rows)


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, found.fetchall()))


@tables
@vocabulary
def test_pipeline(spark):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline as cp
    from epilattice.llm.decontaminate import decontaminate
    from epilattice.llm.jaccard import jaccard_join

    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    for name, stage in cp.STAGES:
        before = now
        now = stage(spark, before, SF).cache()
        ids = {x.doc_id for x in now.collect()}
        assert name == "tokens" or now.columns == columns
        if name == "near_duplicates":
            assert ids == {x.component_id for x in jaccard_join(before).collect()}
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids == {x.doc_id for x in decontaminate(before, bench).where("NOT contaminated").collect()}
    assert now.count() == cp.run(spark, SF).count() and now.where("size(token_ids) <> n_tokens").count() == 0
