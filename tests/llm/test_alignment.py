"""Token alignment against a plain one, with both public libraries."""

import hashlib
import random
from collections import Counter

import pytest

from epilattice.llm import queries as q
from epilattice.llm import token_alignment as ta

A, B = q.BYTE_VOCABULARY, q.VOCABULARY
SCHEMA = "doc_id long, text string, _row int, pair string, n_a int"
TEXTS = [
    None, "", " ", "a", "Hello world, it's the <|endoftext|> of <s> days.", "▁ is a mark", "tabs\tand\n\nlines   and    runs", "naïve café – “quotes” …",
    "汉字和かな mixed 한국어", "🙂🙂 emoji 👩‍👩‍👧 family", "zero\u0000byte", "x" * 3000, "ab" * 700, " " * 500, "antidisestablishmentarianism " * 40, "1234567890 " * 30,
    "'s 'll don't I'D", " nbsp em　wide", "same text", "same text",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def sides():
    with open(A) as a, open(B, "rb") as b:
        return ta.byte_bpe(a.read()), ta.sentencepiece(b.read())


def plain(text):
    """[(ids of A, ids of B)] of each group, by the libraries named in the contract."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    if not text:
        return []
    back = ta.byte_level()
    ids = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    parts = [bytes(back[c] for c in t.id_to_token(i)) for i in ids[0]], [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return []
    ends = []
    for p in parts:
        at = 0
        ends.append([at := at + len(x) for x in p])
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, at = [], [0, 0]
    for c in common:
        own = []
        for k in (0, 1):
            to = ends[k].index(c) + 1
            own.append(ids[k][at[k] : to])
            at[k] = to
        groups.append(tuple(own))
    return groups


def expected(texts):
    groups = [plain(t) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    docs = Counter(p for own in links for p in own)
    top = {}
    for (a, _), n in docs.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for i, (g, own) in enumerate(zip(groups, links, strict=True)):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), sum(n for p, n in own.items() if docs[p] == top[p[0]]),
            sum(n * docs[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
        ))
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_against_a_plain_alignment(spark, frequent):
    got = [tuple(r) for r in ta.alignment_scores(frame(spark, TEXTS), A, B, frequent=frequent).collect()]
    assert sorted(got) == expected(TEXTS)


def test_repeated_rows_and_no_rows(spark):
    rows = frame(spark, TEXTS[:8]).union(frame(spark, TEXTS[:8])).withColumnRenamed("doc_id", "key")
    got = sorted(tuple(r) for r in ta.alignment_scores(rows, A, B, "key").collect())
    want = expected(TEXTS[:8] * 2)
    assert got == sorted((r[0] % 8, *r[1:]) for r in want)
    assert ta.alignment_scores(frame(spark, []), A, B).count() == 0
    assert {r[1] for r in ta.alignment_scores(frame(spark, [None, ""]), A, B).collect()} == {0}


def test_tokens_lie_where_they_should(spark):
    for r in ta.align(frame(spark, TEXTS), A, B).collect():
        groups = plain(TEXTS[r.doc_id])
        assert r.a_ids == [i for x, _ in groups for i in x] and r.b_ids == [i for _, y in groups for i in y] and len(r.group_ends) == len(groups)
        if groups:
            assert r.group_ends == sorted(set(r.a_ends) & set(r.b_ends)) and r.group_ends[-1] == len((" " + TEXTS[r.doc_id]).encode())
            starts = [[0, *e[:-1]] for e in (r.a_ends, r.b_ends)]
            if len(r.a_ids) * len(r.b_ids) < 200_000:
                meet = [(i, j) for i in range(len(r.a_ids)) for j in range(len(r.b_ids)) if starts[0][i] < r.b_ends[j] and starts[1][j] < r.a_ends[i]]
                assert [tuple(o) for o in r.overlaps] == meet


def test_large_groups_are_counted_by_ids(sides, monkeypatch):
    """Groups with more links than are written out at a time."""
    r = random.Random(4)
    texts = ["".join(r.choice("abc") for _ in range(400)) for _ in range(3)] + ["x" * 900, "plain words here", ""]
    pairs = [ta._tokens(t, *sides) for t in texts]
    # one group a text: only the last ends agree
    found = ta.aligned([p[0] for p in pairs], [p[1] for p in pairs], *sides)
    want = Counter()
    for x in found.a.itertuples():
        for y in found.b[found.b["group"] == x.group].itertuples():
            want[x.doc, x.id << 32 | y.id] += 1
    for limit in (1 << 20, 50, 1):
        monkeypatch.setattr(ta, "LINKS", limit)
        parts = list(ta.links(found))
        got = Counter()
        for doc, pair, n in parts:
            for d, p, k in zip(doc.tolist(), pair.tolist(), n.tolist(), strict=True):
                assert (d, p) not in got
                got[d, p] = k
        assert got == want and (limit > 50 or len(parts) > 3)


def test_byte_bpe_is_the_public_library(sides):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    r = random.Random(6)
    for _ in range(300):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 127), r.randrange(0x20, 0x500), r.randrange(0x2000, 0x2100), r.randrange(0x1F600, 0x1F640)])) for _ in range(60))
        assert sides[0].encode(text) == t.encode(text, add_special_tokens=False).ids
    import json

    with open(A) as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True  # no longer what the faster library does
    assert ta.byte_bpe(json.dumps(spec)).encode("word") == Tokenizer.from_str(json.dumps(spec)).encode("word").ids
