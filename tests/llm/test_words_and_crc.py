"""Word spans, checksums of spans, boundary sets and the automaton against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import boundaries, crc, decontaminate, fim, words
from tessella.llm.automaton import Automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return [] if text is None else WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text("abZ09 .-é日😀\n\x00_", max_size=14), max_size=8))
def test_words_equal_the_pattern(texts):
    found = words.words(pa.array(texts, pa.string()))
    for plain in (found, words.joined(found)):
        got = [plain.data[a:b].tobytes().decode() for a, b in zip(plain.start, plain.end)]
        assert [got[a:b] for a, b in zip(found.first[:-1], found.first[1:])] == [plain_words(t) for t in texts]


def test_slices_of_an_array_are_their_own_texts():
    texts = pa.array(["one", None, "two Three", "", "4"]).slice(1, 3)
    found = words.words(texts)
    assert found.first.tolist() == [0, 0, 2, 2] and found.data.tobytes() == b"two three"


def test_checksums_of_spans_of_every_length():
    r = random.Random(1)
    data = np.frombuffer(r.randbytes(300_000), np.uint8)
    spans = [(3, 3 + n) for n in range(400)] + [(0, 300_000), (1, 64 * 64 + 1), (1, 64 * 64 + 2), (9, 64 * 1025 + 8)]
    spans += [(a, a + r.choice([r.randint(0, 70), r.randint(0, 9000)])) for a in (r.randint(0, 290_000) for _ in range(2000))]
    start, end = map(np.array, zip(*spans))
    assert crc.crc32(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]
    assert crc.crc32(data, start[:0], end[:0]).tolist() == []


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 3 * boundaries.SPAN)), st.lists(st.tuples(st.integers(0, 3 * boundaries.SPAN), st.integers(1, 9000)), max_size=4), st.booleans())
def test_boundaries_select_like_a_list(some, runs, dense):
    every = set(some)
    for a, n in runs:
        every |= set(range(a, a + n))
    if dense:
        every |= set(range(0, boundaries.SPAN, 3))
    every, found = sorted(every), boundaries.Boundaries()
    for number in range(4):
        found.add(number, np.array([k - number * boundaries.SPAN for k in every if k // boundaries.SPAN == number], np.int64))
    assert len(found) == len(every)
    for k in {0, len(every) // 2, len(every) - 1, *random.Random(3).sample(range(len(every)), min(60, len(every)))}:
        if 0 <= k < len(every):
            assert found.select(k) == every[k]


def test_every_kind_of_container_is_used():
    kinds = {type(boundaries.container(np.array(low))).__name__ for low in ([1, 5, 9], list(range(50)), list(range(0, 60_000, 3)))}
    assert kinds == {"Array", "Runs", "Bitmap"}


def test_token_ends_equal_the_pattern():
    r = random.Random(2)
    texts = ["", "a", "ab c", "é日ab😀x\n\nYz", "a" * 200_000, "ab " * 50_000, "1" * 70_000 + "a" * 70_000, "a" * boundaries.SPAN, "a" * (boundaries.SPAN - 1) + "b1", "." * boundaries.SPAN]
    texts += ["".join(r.choice(["a", "Zq", "é", " ", "9", "[", "@", "`", "{", "Á"]) for _ in range(r.randint(1, 40))) for _ in range(300)]
    for text in texts:
        ends = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        found = fim.token_ends(text)
        assert len(found) == len(ends)
        assert [found.select(k) for k in range(0, len(ends), max(1, len(ends) // 50))] == ends[:: max(1, len(ends) // 50)]


def longest(text, items, at):
    for n in range(at + 1, 0, -1):
        piece = text[at + 1 - n : at + 1]
        if any(piece == item[i : i + n] for item in items for i in range(len(item) - n + 1)):
            return n
    return 0


def windows(item, window):
    return [item] if 0 < len(item) < window else [item[i : i + window] for i in range(len(item) - window + 1)]


def hits(text, items, window):
    marked, named = set(), set()
    for name, item in items:
        for w in windows(item, window):
            for i in range(len(text) - len(w) + 1):
                if text[i : i + len(w)] == w:
                    marked |= set(range(i, i + len(w)))
                    named.add(name)
    return marked, named


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=30), st.integers(1, 4))
def test_automaton_equals_brute_force(items, text, window):
    automaton = Automaton(window)
    for item in items:
        automaton.add(item)
    for i, item in enumerate(items):
        automaton.name(item, str(i))
    assert [n for _, n in automaton.walk(text)] == [longest(text, items, k) for k in range(len(text))]
    spans, named = automaton.found(text)
    marked, want = hits(text, [(str(i), x) for i, x in enumerate(items)], window)
    assert {k for a, b in spans for k in range(a, b)} == marked and named == want
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_the_bit_tables_rule_out_no_match():
    r = random.Random(6)
    long = "x" * 70
    draw = lambda n: [r.choice(["a", "b", "cd", long, long + "y"]) for _ in range(n)]
    for window in (1, 2, 3, 5):
        items = [(str(i), draw(r.randint(1, 8))) for i in range(4)]
        cells = [(name, [decontaminate._named(w.encode()) for w in item], decontaminate.keys(words.words(pa.array([" ".join(item)])))) for name, item in items]
        part = decontaminate._Part(cells, window)
        texts = [" ".join(draw(r.randint(0, 60)) + ["zz"] * r.randint(0, 2)) for _ in range(40)]
        found = words.words(pa.array(texts))
        got = [set() for _ in texts]
        for a, b in part.runs(found):
            i = int(np.searchsorted(found.first, a, "right")) - 1
            assert b <= found.first[i + 1]
            got[i] |= {a - found.first[i] + k for x, y in part.automaton.found(decontaminate._texts(found, a, b))[0] for k in range(x, y)}
        assert got == [hits(t.split(), items, window)[0] for t in texts]
