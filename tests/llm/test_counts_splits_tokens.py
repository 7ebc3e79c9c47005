"""Problems 3, 7 and 8: against brute force, exact round trips and the public tokenizer."""

import random
import time
import unicodedata
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillfind.llm import bpe, splitter, termcount


# --- frequencies


def brute(rows):
    total, seen, values = defaultdict(int), defaultdict(set), set()
    for record, value in rows:
        v = termcount.normal(value)
        if v:
            total[v] += 1
            seen[v].add(record)
            values.add(record)
    mark = lambda v: "rare" if len(seen[v]) <= 1 else "common" if len(seen[v]) > 0.05 * len(values) else None
    return {(v, n, len(seen[v]), mark(v)) for v, n in total.items()}


def test_frequencies_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["a", " A ", "b  b", "B B", "é", "é", "É", "c", "", "  ", " ", None, "x" * 5000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(words) if rng.random() < 0.6 else f"w{rng.randint(0, 50)}") for _ in range(2000)]
    df = spark.createDataFrame([(r, v, 1, 2) for r, v in rows], "fragment long, normalized string, n_rows int, mark int").repartition(7)
    assert {tuple(r) for r in termcount.marked(df).collect()} == brute(rows)
    assert {tuple(r) for r in termcount.marked(df, slices=1).collect()} == brute(rows)


def test_frequencies_of_nothing(spark):
    df = spark.createDataFrame([], "fragment long, normalized string")
    assert termcount.marked(df).count() == 0
    assert termcount.marked(spark.createDataFrame([(1, None), (2, " ")], "fragment long, normalized string")).count() == 0


def test_normal_form():
    assert [termcount.normal(x) for x in ["  Foo\t BAR ", "É", "　"]] == ["foo bar", "é", None]
    assert unicodedata.is_normalized("NFC", termcount.normal("Å ngström"))


# --- splitting


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab é漢😀.\n!? \r", max_size=400), st.integers(12, 60), st.integers(0, 6))
def test_pieces_cover_the_text(text, limit, overlap):
    found = splitter.pieces(text, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for a, b, x, y in found:
        part = text[a:b].encode()
        assert len(part) <= limit and text.encode()[x:y] == part
    for (a, b, _, y), (c, d, x, _) in zip(found, found[1:]):
        assert a < c <= b < d and 0 <= y - x <= overlap + 3
    # the overlaps taken off, the pieces are the text again
    whole = text[: found[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(found, found[1:]))
    assert whole == text


def test_cut_at_the_strongest_boundary():
    text = "One two three. " * 10 + "\n\n" + "Four five six. " * 20
    a = splitter.pieces(text, 200, 20)
    assert text[: a[0][1]].endswith("\n\n")
    assert splitter.pieces("x" * 500, 200, 20)[0][1] == 200  # nothing natural: hard cut


def test_split_table(spark):
    rows = [(1, "a" * 3200, 0), (2, "b " * 3000, 0), (3, None, 0), (4, "", 0), (5, "é" * 1601, 0), (2, "b " * 3000, 0)]
    df = spark.createDataFrame(rows, "id long, text string, piece_no int")
    got = splitter.split_oversized(df).collect()
    assert sorted({r["id"] for r in got}) == [2, 5]
    assert all(len(r["text"].encode()) <= 3200 and r["extent"]["last_pos"] - r["extent"]["first_pos"] == len(r["text"].encode()) for r in got)
    assert splitter.split_oversized(df.limit(0)).count() == 0


# --- byte-level BPE


def encoder_and_truth():
    from tokenizers import Tokenizer

    truth = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    truth.encode_special_tokens = True
    return bpe.encoder(bpe.Vocabulary(bpe.read_ranks())), lambda texts: [x.ids for x in truth.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_public_tokenizer(spark):
    run, truth = encoder_and_truth()
    rng = random.Random(4)
    texts = ["", "Hello world", "<|endoftext|> don't WE'LL", "naïve 漢字 😀‍", " " * 40 + "x", "a" * 3000, "aaaaab" * 50, "\r\n\t x y"]
    texts += ["".join(rng.choice("abcdeinorst  \n") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    texts += ["".join(chr(rng.randint(32, 0x3000)) for _ in range(30)) for _ in range(500)]
    assert run(texts) == truth(texts)
    df = spark.createDataFrame([(1, "Hello world", 3), (2, None, 3), (3, "", 3), (1, "Hello world", 3)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df).collect())
    hello = truth(["Hello world"])[0]
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    assert bpe.encode(df.limit(0)).count() == 0


def test_pair_check_equals_merging():
    ranks = bpe.read_ranks()
    v, inverse = bpe.Vocabulary(ranks), {r: t for t, r in ranks.items()}
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    want = [v.merge(inverse[x] + inverse[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert v.compatible(a, b).tolist() == want


def test_long_words_are_merged_in_n_log_n():
    """A megabyte without a blank, and the same result as by scanning."""
    v = bpe.Vocabulary(bpe.read_ranks())
    rng = random.Random(7)
    for n in (48, 60, 200, 500):
        word = "".join(rng.choice("abcdeinorst") for _ in range(n)).encode()
        parts = [word[i : i + 1] for i in range(n)]
        while True:  # the pair of lowest rank, the leftmost first
            ranked = [(v.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.ranks]
            if not ranked:
                break
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert v.merge(word) == [v.ranks[p] for p in parts]
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.process_time()
    ids = bpe.encoder(v)([word])[0]
    assert time.process_time() - began < 20
    inverse = {r: t for t, r in v.ranks.items()}
    assert b"".join(inverse[i] for i in ids) == word.encode()
    same = bpe.Vocabulary.of(v.parts())
    assert same.merge(b"unbelievable" * 10) == v.merge(b"unbelievable" * 10)
