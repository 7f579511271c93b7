"""Alignment of two tokenizers against all pairs of tokens, text by text."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import alignment as A
from vintage_jobs.llm.packing import tokenizer_path


@pytest.fixture(scope="module")
def own():
    return A.Aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.tiktoken"))


def tokens(own, text):
    """(id, bytes) of A and B by the libraries, decoded independently; None where the bytes differ."""
    from tokenizers.decoders import ByteLevel

    if not text:
        return None
    a, b = own.a.encode(" " + text, add_special_tokens=False), own.b.encode(text)
    table = {c: i for i, c in enumerate_bytes()}
    of_a = [(i, bytes(table[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    of_b = [(i, bytes.fromhex(p[3:5]) if own.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, own.b.id_to_piece(i)) for i in b)]
    data = (" " + text).encode()
    assert ByteLevel().decode(a.tokens) == " " + text
    return (of_a, of_b) if b"".join(x for _, x in of_a) == data == b"".join(x for _, x in of_b) else None


def enumerate_bytes():
    from tokenizers import pre_tokenizers

    assert len(pre_tokenizers.ByteLevel.alphabet()) == 256
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return [(b, chr(b)) for b in shown] + [(b, chr(256 + i)) for i, b in enumerate(rest)]


def spans(of):
    at = 0
    for i, data in of:
        yield i, at, at + len(data)
        at += len(data)


def brute(own, texts):
    counts, links, shown = Counter(), [], []
    for text in texts:
        found = tokens(own, text)
        pairs, groups = [], ""
        if found:
            a, b = (list(spans(x)) for x in found)
            pairs = [(i, j) for i, s, e in a for j, t, u in b if s < u and t < e]
            ends = sorted({e for *_, e in a} & {u for *_, u in b})
            cut = [([str(i) for i, s, e in a if lo <= s and e <= hi], [str(j) for j, t, u in b if lo <= t and u <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
            groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in cut)
        counts.update(pairs)
        links.append(pairs)
        shown.append((len(found[0]) if found else 0, len(found[1]) if found else 0, groups))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(n_a, n_b, g.count(";") + 1 if g else 0, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), digest(g)) for (n_a, n_b, g), p in zip(shown, links, strict=True)]


TEXTS = [
    "", "one", "It's a test, isn't it? 3.5% of 10", "first line.\nSecond line\nthird", "two  blanks", "tab\tand\xa0nbsp", " lead", "trail ", "a\n\nb", "é ß 中文 😀 a",
    "x<|endoftext|>y <|endoftext|> z", "a \nb", "\n", "　x y", "</s> <s> <unk> <0x0A>", "a▁b", "▁", "naïve’s café—“quoted” 12ab34 x²", "ﬁne print", "a\x00b", "don't don't don't the the", "the the a",
]


def test_words_align_as_whole_texts(own):
    split = own.by_parts(TEXTS)
    assert sum(s is not None for s in split) >= 10
    for text, places in zip(TEXTS, split, strict=True):
        whole = own.whole(text)
        if places is None:
            continue
        sizes = own.sizes[places]
        assert (whole is None) == bool((sizes < 0).any())
        if whole:
            assert ";".join(own.groups[i] for i in places) == whole[0] and tuple(sizes.sum(axis=0)) == whole[1]
            assert sum((own.links[i] for i in places), []) == whole[2]


def test_words_are_aligned_together_as_alone(own):
    own.forget()
    words = [" one", "\n", "Größe,", " 日本語", " a\u2581b", " \u2581", "x" * 400, " 😀", " e\u0301", "1234567", " </s>", " "]
    own._learn(words)
    for word, n, of, links in zip(words, own.sizes.tolist(), own.groups, own.links, strict=False):
        a = own._ids([word])[0]
        b = own.b.encode(word[1:]) if word[0] == " " else own.b.encode(word if word == "\n" else "\n" + word)[1 if word == "\n" else 2 :]
        found = own.compared(word.encode(), a, b)
        assert (of, links) == ((found[0], found[2]) if found else ("", [])) and n == ([len(a), len(b), found[1], len(found[2])] if found else [-1] * 4), word
    made = own.aligned_all([[], own._ids([" one"])[0], []], [[], own.b.encode("one"), []])
    assert made[0][0] == made[0][2] == "" and made[0][1] == own.groups[0] and made[1][[0, 2]].tolist() == [[0] * 4] * 2
    assert [len(x) for x in own.aligned_all([[]], [[]])] == [1, 1, 0]
    own.forget()


def test_links_of_a_group():
    assert A.aligned([1, 2, 3], [7, 8], {1: 2, 2: 1, 3: 4}, {7: 3, 8: 4}) == ("1,2|7;3|8", 2, [7 << 32 | 1, 7 << 32 | 2, 8 << 32 | 3])
    assert A.aligned([1, 2], [7, 8], {1: 1, 2: 3}, {7: 2, 8: 2}) == ("1,2|7,8", 1, [7 << 32 | 1, 7 << 32 | 2, 8 << 32 | 2])


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_texts_against_all_pairs(spark, own, monkeypatch, words):
    monkeypatch.setattr(A, "linked", lambda docs, f=A.linked: f(docs, words=words))
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in A.alignment_digest(docs).collect())
    assert got == [(i, *w) for i, w in enumerate(brute(own, TEXTS * 3))]


def test_whole_table(spark, own, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where(F.length("text") < 4000)
    rows = sorted(docs.select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in A.alignment_digest(docs).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, brute(own, [r.text for r in rows]), strict=True)}


def test_hot_pairs_are_dealt(spark, own, monkeypatch):
    monkeypatch.setattr(A, "linked", lambda docs, f=A.linked: f(docs, words=1))
    texts = ["the the a", "the end", *["the"] * 1500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = A.linked(docs)
    assert rows.where("pair is not null").groupBy("pair").count().agg(F.max("count")).first()[0] > 2
    assert sorted(tuple(r) for r in A.alignment_digest(docs).collect()) == [(i, *w) for i, w in enumerate(brute(own, texts))]


def test_edge_rows(spark, own):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "a b"), (3, "a b"), (4, "word " * 9000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).withColumn("batch", F.lit(2))
    got = sorted((r.doc_id or 0, *tuple(r)[1:6]) for r in A.alignment_digest(docs).collect())
    assert got[0][:2] == (0, 2) and got[1] == got[2] == (1, 0, 0, 0, 0, 0) and got[4] == got[5] and got[-1][1] == 9001
    assert A.alignment_digest(docs.limit(0)).count() == 0
