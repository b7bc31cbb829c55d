import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import canonical, format_copies, leakage, splitting
from tessella.llm.chunking import chunk_batch


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｃａｆｅ́　ｘ", "café x"),
        ("a\u200bb\u00adc", "abc"),
        ("ѕ\u0435е\u0301", "see\u0301"),
        ("ό", "ó"),
        ("‑ﬁﬃ", "-fiffi"),
        ("a\u00a0b\u2009c", "a b c"),
        ("x\r\ny", "x\ny"),
        ("161 µs", "161 μs"),
        ("e\u200b\u0301", "é"),
        ("Ꭺpple", "Apple"),
        ("օne", "one"),
        ("ρay", "pay"),
        ("νiew", "view"),
        ("ɑpple", "apple"),
    ],
)
def test_equal_looks(a, b):
    run = canonical.transducer()
    assert run(a) == run(b)


@pytest.mark.parametrize(("a", "b"), [("e", "é"), ("A", "a"), ("ß", "ss"), ("x\ny", "x y"), ("x²", "x2"), ("a-b", "a—b"), ("λ", "l")])
def test_different_looks(a, b):
    run = canonical.transducer()
    assert run(a) != run(b)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_form_is_stable_and_blind_to_composition(text):
    run = canonical.transducer()
    once = run(text)
    assert run(once) == once
    assert run(unicodedata.normalize("NFD", text)) == run(unicodedata.normalize("NFC", text))


def test_conflicts_are_refused(monkeypatch):
    monkeypatch.setitem(canonical.LOOK_ALIKES, "again", ("а", "o"))
    canonical.mapping.cache_clear()
    with pytest.raises(ValueError, match="two outputs"):
        canonical.mapping()
    monkeypatch.undo()
    canonical.mapping.cache_clear()
    assert canonical.mapping()


def test_a_table_against_the_rules_is_refused(monkeypatch):
    monkeypatch.setitem(canonical.LOOK_ALIKES, "against", ("ａ", "b"))  # the rules make it an a
    canonical.mapping.cache_clear()
    with pytest.raises(ValueError, match="two outputs"):
        canonical.mapping()
    monkeypatch.undo()
    canonical.mapping.cache_clear()


def test_look_alike_pairs_and_classes(spark):
    rows = spark.createDataFrame([(1, "abc", "k"), (2, "аbc", "k"), (3, "abc", "k"), (4, None, "k"), (5, "", "k"), (6, "abd", "k")], "doc_id bigint, text string, id string")
    pairs = {tuple(r) for r in canonical.look_alike_pairs(rows, "doc_id", "text").collect()}
    assert pairs == {(1, 2), (2, 3)}
    classes = {r["id"]: (r["class_id"], r["variants"]) for r in canonical.look_alike_classes(rows, "doc_id", "text").collect()}
    assert classes == {1: (1, 2), 2: (1, 2), 3: (1, 2), 5: (5, 1), 6: (6, 1)}
    assert canonical.look_alike_pairs(rows.limit(0), "doc_id", "text").count() == 0


def test_format_copies(spark):
    rows = spark.createDataFrame(
        [
            (1, "On X - y", ["Doe, Jane", "A. B. Cee"]),
            (2, " on x – Y!", ["Cee, A.B.", "JANE DOE"]),
            (3, "On X y", ["Jane Doe"]),
            (4, "On X y", None),
            (5, "on x y", []),
            (6, None, None),
            (7, None, None),
            (8, "ön x y", []),
            (9, "On X y", ["Doe Jane", "Jane, Doe"]),
        ],
        "paper_id bigint, title string, authors array<string>",
    )
    got = {(r["copy_id"], r["kept_id"], r["copies"]) for r in format_copies.format_copies(rows, "paper_id", ["title"], ["authors"]).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (4, 4, 2), (5, 4, 2), (3, 3, 2), (9, 3, 2)}
    kept = {(r["kept_id"], r["copies"]) for r in format_copies.collapse(rows, "paper_id", ["title"], ["authors"]).collect()}
    assert kept == {(1, 2), (3, 2), (4, 2), (8, 1)}
    assert format_copies.format_copies(rows.limit(0), "paper_id", ["title"], ["authors"]).count() == 0


def test_collapsed_keeps_records_without_a_key(spark, tmp_path):
    from tessella.llm import queries

    spark.createDataFrame([(1, "On X", None), (2, "on x", []), (3, None, ["Jane Doe"]), (4, None, None)], "paper_id bigint, title string, authors array<string>").write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame([(5, "doi:10.1/a"), (6, None)], "record_id bigint, identity string").write.parquet(str(tmp_path / "seen_papers.parquet"))
    got = {tuple(r) for r in queries.p6_collapsed(spark, str(tmp_path)).collect()}
    assert got == {("papers", 1, 2), ("papers", 3, 1), ("papers", 4, 1), ("seen_papers", 5, 1), ("seen_papers", 6, 1)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["7", "19", "kg", "hours"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 40)))) for i in range(12)] + [(99, None), (100, "")]
    docs = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        source = (items[i % 12][1] or "").split()
        n = rng.randint(8, 16)
        at = rng.randint(0, max(0, len(source) - n))
        docs.append((i, " ".join(words[:20]).upper() + ",\n" + " ".join(f"*{w}*" for w in source[at : at + n]) + "\u00a0" + " ".join(words[20:])))
    docs += [(70, None), (71, "")]
    want = set()
    for d, t in docs:
        for i, s in items:
            dw, iw = leakage.words_of(t or ""), leakage.words_of(s or "")
            if any(dw[a : a + 12] == iw[b : b + 12] for a in range(len(dw) - 11) for b in range(len(iw) - 11)):
                want.add((d, i))
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for bits in (leakage.MOST_BITS, 1 << 6):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(dd, ii, most_bits=bits).where("exact_windows > 0").collect()}
        assert got == want and want
    assert leakage.leaks(dd.limit(0), ii).count() == 0
    assert leakage.leaks(dd, ii.limit(0)).count() == 0


def test_other_numbers_are_caught_if_consistent(spark):
    item = "a tank holds 40 litres and loses 3 litres per hour so after 5 hours it holds 25 litres"
    same = "A tank holds 90 litres and loses 8 litres per hour, so after 7 hours it holds 25 litres."
    mixed = "a tank holds 90 kg and loses 8 litres per hour so after 7 hours it holds 25 litres"
    docs = spark.createDataFrame([(1, same), (2, mixed), (3, item)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["exact_windows"], r["template_windows"]) for r in leakage.leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"), width=15).collect()}
    assert got[3] == (5, 0) and got[1][0] == 0 and got[1][1] == 5
    assert 2 not in got or got[2][1] < 5


def test_questions_with_fresh_names_numbers_and_units_are_found(spark):
    """Planted: 40 of 60 items stand in a document with other names, numbers and units; 20 documents only resemble one."""
    rng = random.Random(8)
    name = lambda: "".join(rng.choice(c) for c in ("BDFGKLMNPRSTVZ", "aeiou", "bdfgklmn", "aeiou", "rstx"))
    verbs, things = ["buys", "sells", "paints", "counts", "hides", "lends"], ["apples", "barrels", "candles", "doors", "engines", "feathers", "globes"]

    def fill(shape, values):
        return shape.format(**values)

    values = lambda: {"a": name(), "b": name(), "n": rng.randint(2, 499), "m": rng.randint(500, 999), "u": rng.choice(["hours", "days", "weeks"])}
    shapes = []
    for _ in range(60):
        w = rng.sample(verbs, 3) + rng.sample(things, 3)
        shapes.append(f"every morning {{a}} {w[0]} {{n}} {w[3]} near the {w[4]} before {{b}} {w[1]} {{m}} of them, and after {{m}} {{u}} {{a}} {w[2]} the {w[5]} that {{b}} left behind")
    items = [(i, fill(s, values())) for i, s in enumerate(shapes)]
    docs = [(i, "Some words first. " + fill(shapes[i], values()) + ". Some words after.") for i in range(40)]
    for i in range(40, 60):  # the same words with slots that don't agree among themselves
        v = values()
        docs.append((i, fill(shapes[i].replace("{a}", "{b}", 1), v).replace(v["b"], name(), 1)))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.reparameterised(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {(i, i) for i in range(40)}
    print("re-parameterised: recall", len(got & want) / len(want), "precision", len(got & want) / len(got))
    assert got & want == want and len(got - want) <= 2


def test_a_fresh_name_is_a_slot(spark):
    item = "the crates of Vexlor hold nineteen teal lamps and weigh less than any other crates do"
    docs = spark.createDataFrame([(1, item), (2, item.replace("Vexlor", "Zorbla")), (3, item.upper())], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["exact_windows"], r["template_windows"]) for r in leakage.leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (5, 0), 2: (1, 4), 3: (5, 0)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\r.→\t", max_size=400), st.integers(9, 80), st.integers(0, 30))
def test_pieces_rebuild_the_text(text, limit, overlap):
    raw, end = text.encode(), 0
    pieces = splitting.split_text(text, limit, overlap)
    for begin, first, last, piece, _ in pieces:
        size = len(piece.encode())
        assert size <= limit and raw[begin : begin + size] == piece.encode() and begin <= end
        assert first == raw[:begin].count(b"\n") and last == raw[: begin + size].count(b"\n")
        end = begin + size
    assert end == len(raw)
    cut = {p[4] for p in pieces if p[4]}
    assert cut == {p for p in splitting.paragraphs(text) if p[1] - p[0] > limit}


def test_an_edit_alters_neighbouring_pieces_only():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(6000))
    edited = text[:20000] + "XY " + text[20000:]
    a, b = ({p[3] for p in splitting.split_text(t, 1000, 0)} for t in (text, edited))
    assert len(a - b) <= 4


def test_split_items(spark):
    items = spark.createDataFrame(
        [(1, "C:\\x\\a.MD", 100, 7, "one line of text\n\n" + "word " * 20, "s"), (2, "/d/noext", None, 1, "word " * 20, "s"), (3, "/d/a.md", 0, 1, None, "s"), (4, "/d/a.md", 0, 1, "", "s")],
        "item_no bigint, file_path string, byte_offset bigint, line_start int, text string, max_bytes string",
    )
    limits = spark.createDataFrame([(".md", 40, 0), ("", 60, 10)], "suffix string, max_bytes int, overlap_bytes int")
    pieces = splitting.split_items(items, limits)
    assert {tuple(r) for r in splitting.oversize_paragraphs(pieces).collect()} == {(1, 118, 9, 9), (2, None, 1, 1)}
    assert pieces.where("item_no = 4").count() == 1 and pieces.where("item_no = 3").count() == 0
    assert all(r["n_bytes"] <= (40 if r["item_no"] == 1 else 60) for r in pieces.collect())


def test_chunks_cover_their_streams_and_depend_on_them_alone():
    rng = random.Random(3)
    streams = ["".join(rng.choices("abcdef", k=rng.randint(0, 90))).encode() for _ in range(50)]
    owner, chunk, size = chunk_batch(streams, 8)
    assert np.bincount(owner, size, minlength=50).tolist() == [len(s) for s in streams]
    for i in (7, 21):
        alone = chunk_batch([streams[i]], 8)
        assert chunk[owner == i].tolist() == alone[1].tolist()
    assert len(chunk_batch([], 8)[0]) == 0 and len(chunk_batch([b""], 8)[0]) == 0
