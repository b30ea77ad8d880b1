"""Books from pages: numbers, speakers and lengths against plain loops, and how often texts are written (finding of round 4)."""

import random
import re

from timedframe.operators import ordered
from timedframe.operators import segments as sg
from timedframe.plans import media as pl


def pages_and_lines(rng):
    """Rows ``book, doc, text`` and the sentences of each book in order."""
    rows, books = [], {}
    for doc in range(24):
        book = "long" if doc % 3 else rng.choice(["a", "b"])
        paras = []
        for _ in range(rng.randrange(0, 6)):
            said = [" ".join(rng.choice(["one", "näive", "three"]) for _ in range(rng.randrange(1, 60 if book == "long" else 4))) + rng.choice(".!?") for _ in range(rng.randrange(1, 5))]
            paras.append(said)
        rows.append((book, doc, "\n\n".join(" ".join(p) for p in paras)))
        books.setdefault(book, []).extend(s for p in paras for s in p)
    return [*rows, (None, 30, "No book. Left out."), ("a", None, "No number."), ("empty", 31, " \n\n ")], books


def stored(spark, rows, path):
    """The pages as a table of known size; a list of rows has none."""
    spark.createDataFrame(rows, "book string, doc long, text string").coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_book_against_a_loop(spark, grouping, tmp_path):
    rows, books = pages_and_lines(random.Random(8))
    tags = [(b, i, f" {n} ") for b, i, n in [("long", 1, "ann"), ("long", 5, "bo"), ("a", 2, "ann"), ("b", 1, ""), ("a", 900, "cy")]]
    speaker = {(b, i): n.strip() for b, i, n in tags if n.strip()}
    pages = stored(spark, rows, tmp_path / "pages")
    said, voices, text = pl.assemble_book(pages, spark.createDataFrame(tags, "media_id string, seg_id long, speaker string"), ["v1", "v2"], "v1")
    want = [(b, i, speaker.get((b, i), "narrator"), s) for b, all_ in books.items() for i, s in enumerate(all_, 1)]
    assert sorted((r.media_id, r.seg_id, r.speaker, r.text) for r in said.collect()) == sorted(want)
    assert set(said.columns) == {"media_id", "seg_id", "start", "end", "text", "speaker"}
    told = {b: "\n".join(s if who == "narrator" else f"[{who}] {s}" for x, _, who, s in want if x == b) for b in books}
    assert len(told["long"]) > sg.TEXT_CAP
    assert sorted((r.media_id, r.n_chars, r.preview) for r in text.collect()) == sorted((b, len(t), t if len(t) <= sg.TEXT_CAP else None) for b, t in told.items() if t)
    assert {(r.media_id, r.speaker) for r in voices.collect()} == {(b, who) for b, _, who, _ in want} | {(b, "narrator") for b in told if told[b]}


def test_texts_of_a_large_book_are_written_and_dealt_out_once(spark, monkeypatch, tmp_path):
    """of what is kept on disk, one copy holds texts; lengths are summed without them."""
    copies, real = [], ordered.materialize

    def kept(df):
        copies.append(df.schema.simpleString())
        return real(df)

    for module in (ordered, sg, pl):
        monkeypatch.setattr(module, "materialize", kept)
    rows, _ = pages_and_lines(random.Random(9))
    spark.conf.set(ordered.GROUP_LIMIT_CONF, "7")
    try:
        tags = spark.createDataFrame([("long", 1, "ann")], "media_id string, seg_id long, speaker string")
        _, _, text = pl.assemble_book(stored(spark, rows, tmp_path / "pages"), tags, ["v1"])
        assert sum(bool(re.search(r"\btext:string|\bt:string", c)) for c in copies) == 1
        totals = text._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(ordered.GROUP_LIMIT_CONF)
    sums = totals[: totals.index("bit_get")]  # the sums come first; the preview's rows are filtered before they are dealt out
    assert "chars" in sums and not re.search(r"length\(.*line", sums)


def test_sentences_of_segments_with_one_id_take_turns(spark, grouping):
    rows = [("m", 1, 0.0, 1.0, "A1. A2. A3."), ("m", 1, 0.0, 1.0, "B1. B2."), ("m", None, 0.0, 1.0, "N1. N2."), (None, 1, 0.0, 1.0, "X1. X2."), ("m", 2, 1.0, 2.0, "C1.")]
    got = sg.split_sentences(spark.createDataFrame(rows, "media_id string, seg_id long, start double, end double, text string")).collect()
    by = {r.seg_id: r.text for r in got if r.media_id == "m"}
    assert [by[i] for i in (1, 2)] == ["N1.", "N2."] and {by[3], by[4]} == {"A1.", "B1."} and {by[5], by[6]} == {"A2.", "B2."} and [by[7], by[8]] == ["A3.", "C1."]
    assert sorted((r.seg_id, r.text) for r in got if r.media_id is None) == [(1, "X1."), (2, "X2.")]


def test_numbers_of_sentences_without_repeated_ids(spark, grouping):
    rows = [(m, i, float(k), k + 1.0, " ".join(f"{m}{i}s{j}." for j in range(1 + (k * 7) % 5))) for k, (m, i) in enumerate((m, i) for m in (None, "a", "b") for i in (None, 3, 5, 6, 9, 12))]
    out = sg.split_sentences(spark.createDataFrame(rows, "media_id string, seg_id long, start double, end double, text string"), chars="n")
    assert out.columns == ["media_id", "seg_id", "start", "end", "text", "n"]
    got = sorted(((str(r.media_id), r.seg_id, r.text, r.n) for r in out.collect()))
    want = []
    for m in (None, "a", "b"):
        said = [s for r in rows if r[0] == m for s in r[4].split()]
        want += [(str(m), k, s, len(s)) for k, s in enumerate(said, 1)]
    assert got == sorted(want)
