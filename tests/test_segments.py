import random
import re

import pytest
from pyspark.sql import functions as F

from timedframe.operators import corpus as cp
from timedframe.operators import segments as sg

SEG = "media_id long, seg_id long, start double, end double, text string"


def segs(spark, data):
    return spark.createDataFrame(data, SEG).repartition(3)


def merged_by_hand(rows):
    """Plain loop over the rules: gap, length, chain and sentence end."""

    def open_end(r):
        t = re.sub(r"\s+$", "", r[4])
        t = t.rstrip(sg.TRAILING_QUOTES)
        return not (t and t[-1] in sg.SENTENCE_TERMINATORS) or r[3] - r[2] >= 18.5

    out, i = [], 0
    while i < len(rows):
        chain = [rows[i]]
        while len(chain) < 3 and i + 1 < len(rows):
            nxt = rows[i + 1]
            if not open_end(chain[-1]) or nxt[2] - chain[-1][3] > 1.5 or nxt[3] - chain[0][2] > 45.0:
                break
            chain.append(nxt)
            i += 1
        out.append((chain[0][0], chain[0][1], chain[0][2], chain[-1][3], "".join(c[4] for c in chain)))
        i += 1
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_merge_dangling(spark, grouping, monkeypatch, block):
    monkeypatch.setattr(sg, "MERGE_BLOCK", block)
    r = random.Random(7)
    data, want = [], []
    for m in range(3):
        t, mine = 0.0, []
        for i in range(40 if m == 0 else 6):
            d = r.choice([2.0, 9.0, 17.0, 19.0])
            mine.append((m, i, t, t + d, r.choice(["a", "b.", 'c."', "d。」", "e "])))
            t += d + r.choice([0.0, 0.0, 1.0, 2.0])
        data += mine
        want += merged_by_hand(mine)
    got = sorted((r.media_id, r.seg_id, r.start, r.end, r.text) for r in sg.merge_dangling(segs(spark, data)).collect())
    assert got == sorted(want)


def test_merge_appends_words(spark):
    w = "array<struct<word:string,start:double,end:double>>"
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", [("a", 0.0, 1.0)]), (1, 1, 1.0, 2.0, "b.", None), (1, 2, 2.0, 3.0, "c.", [("c", 2.0, 3.0)])], SEG + ", words " + w)
    got = {r.seg_id: [x.word for x in r.words or []] for r in sg.merge_dangling(df).collect()}
    assert got == {0: ["a"], 2: ["c"]}


def test_cascade_never_overlaps_and_skips(spark, grouping):
    r = random.Random(3)
    data = [(m, i, i * 2.0, i * 2.0 + 2.0, "x" * r.randint(1, 60)) for m in range(2) for i in range(15)]
    df = segs(spark, data).withColumn("dur", F.length("text") / 11.0)
    got = sg.cascade(df, rate=1000, skip=F.col("seg_id") % 5 == 3).orderBy("media_id", "seg_id").collect()
    for m in range(2):
        cursor = 0
        for row in (g for g in got if g.media_id == m):
            if row.seg_id % 5 == 3:
                assert (row.placed_start, row.placed_end, row.drift_s) == (row.start, row.end, None)
                continue
            start = max(round(row.start * 1000), cursor)
            cursor = start + round(len(row.text) / 11.0 * 1000)
            assert (row.placed_start, row.placed_end) == (start / 1000, cursor / 1000)


def lines_by_hand(text, n):
    text = text.strip()
    if not text:
        return []
    if len(text) <= n:
        return [text]

    def pack(parts):
        out = []
        for p in parts:
            if out and len(out[-1]) + 1 + len(p) <= n:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    rough = pack([c.strip() for c in re.split(r"(?<=[,;])\s+", text) if c.strip()])
    return [f for line in rough for f in ([line] if len(line) <= n else pack(line.split()))]


def test_cue_lines_and_times(spark):
    r = random.Random(5)
    texts = ["", "  ", "short", "x" * 60] + [" ".join(r.choice(["aa,", "bbbb", "c;", "dddddddd"]) for _ in range(r.randint(1, 40))) for _ in range(40)]
    df = spark.createDataFrame([(1, i, float(i), i + 1.0, t) for i, t in enumerate(texts)], SEG)
    lined = sg.cue_lines(df, 20)
    for row in lined.collect():
        assert row.lines == lines_by_hand(row.text, 20)
    for key, cues in _by(sg.cue_times(lined).orderBy("seg_id", "cue").collect(), "seg_id").items():
        assert cues[0].start == key and cues[-1].end == key + 1.0  # cues tile the segment
        assert all(a.end == pytest.approx(b.start) for a, b in zip(cues, cues[1:]))


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_split_sentences_tiles_segment(spark, grouping):
    df = segs(spark, [(1, 0, 0.0, 10.0, "One. Two!  Three? four"), (1, 1, 10.0, 12.0, " alone "), (2, 0, 1.0, 2.0, "A. B.")])
    got = sg.split_sentences(df).orderBy("media_id", "seg_id").collect()
    assert [(r.media_id, r.seg_id, r.text) for r in got] == [
        (1, 1, "One."), (1, 2, "Two!"), (1, 3, "Three?"), (1, 4, "four"), (1, 5, " alone "), (2, 1, "A."), (2, 2, "B."),
    ]
    assert got[0].start == 0.0 and got[3].end == 10.0 and got[0].end == pytest.approx(10 * 4 / 18)


def test_untranslated_gate(spark):
    cases = {"": True, "你好世界": True, "Ha ha ha ha ha.": False, "This is plain English": True, "Xin chào các bạn nhé": False, "ok": False}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r.text: r.untranslated for r in sg.flag_untranslated(df).collect()} == cases
    assert not sg.flag_untranslated(df.filter("text like 'This%'"), target="English").first().untranslated


def test_reading_order_holds_few_boxes(spark, grouping):
    """Steps of 0 to 9 px make one band of a whole page; what is arranged at a time stays small, and each page numbers its own boxes."""
    r = random.Random(4)
    boxes = []
    for page in (None, "a", "b"):
        y = 0
        for i in range(700):
            y += r.choice([0, 0, 3, 9, 9])
            boxes.append((page, i, r.randint(0, 400), y))
    want = []
    for page in (None, "a", "b"):
        placed = []
        for _, i, x, y in sorted((b for b in boxes if b[0] == page), key=lambda b: (b[3], b[2], b[1])):
            at = len(placed)
            while at and abs(y - placed[at - 1][2]) < 10 and x < placed[at - 1][1]:
                at -= 1
            placed.insert(at, (i, x, y))
        want += [(str(page), i, k) for k, (i, _, _) in enumerate(placed, 1)]
    out = sg.reading_order(spark.createDataFrame(boxes, "page_id string, line_idx long, x int, y int"))
    assert sorted((str(b.page_id), b.line_idx, b.reading_pos) for b in out.collect()) == sorted(want)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_reading_order(spark, grouping):
    r = random.Random(9)
    boxes = [(p, i, r.randint(0, 400), r.randint(0, 12) * 7) for p in range(3) for i in range(30)]
    got = sg.reading_order(spark.createDataFrame(boxes, "page_id long, line_idx long, x int, y int")).collect()
    for p in range(3):
        want = sorted(((y, x, i) for q, i, x, y in boxes if q == p))
        for i in range(len(want) - 1):
            j = i
            while j >= 0 and abs(want[j + 1][0] - want[j][0]) < 10 and want[j + 1][1] < want[j][1]:
                want[j], want[j + 1] = want[j + 1], want[j]
                j -= 1
        mine = sorted((g for g in got if g.page_id == p), key=lambda g: g.reading_pos)
        assert [g.line_idx for g in mine] == [w[2] for w in want]


def chunks_by_hand(text, n):
    out = []
    for para in (p.strip() for p in re.split(r"[\r\n]+", text.strip())):
        buf = ""
        pieces = []
        for s in (s.strip() for s in re.split(r"(?<=[.!?…])\s+", para)):
            if len(s) <= n:
                pieces.append((s, False))
                continue
            for i, c in enumerate(c.strip() for c in re.split(r"(?<=[,;:\-–—])\s+", s)):
                words = [c] if len(c) <= n else re.findall(r"(?is)<en>.*?</en>|\S+", c)
                pieces += [(w, i == 0 and j == 0 or (len(c) > n and j == 0)) for j, w in enumerate(words)]
        for t, fresh in (p for p in pieces if p[0]):
            if buf and (fresh or len(buf) + 1 + len(t) > n):
                out.append(buf)
                buf = t
            else:
                buf = f"{buf} {t}" if buf else t
        if buf:
            out.append(buf)
    return out


def test_chunk_text(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice(["aa,", "bbb.", "cccc", "<en>u s d</en>", "e!\n", "ffffffff"]) for _ in range(r.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = _by(cp.chunk_text(df, 24).orderBy("id", "para", "chunk_no").collect(), "id")
    for i, t in enumerate(texts):
        assert [g.chunk for g in got[i]] == chunks_by_hand(t, 24)


def test_balanced_chunks():
    long = "word " * 30 + "tail, " + "more " * 30
    got = cp.balanced_chunks(long.strip() + "! Ok.", 60, 10)
    assert all(len(c) <= 62 for c, _ in got)
    assert not got[0][1] and got[-1][1] and got[-1][0].endswith("Ok.")
    assert cp.balanced_chunks("Hi. This is a sentence.", 60, 10) == [("Hi This is a sentence.", True)]
    assert cp.balanced_chunks("x" * 50000, 256, 10)[0][0] == "x" * 256 + "."


def test_clean_punctuation(spark):
    cases = {"a.,b": "a.b", "wait ,;! what": "wait !" + " what", "no.. !": "no!", "really?!.": "really!", "so.?": "so?", "x , y": "x y"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.c for r in df.select("t", cp.clean_punctuation(F.col("t")).alias("c")).collect()} == cases


def test_sentences_of_large_tables_are_split_once(spark):
    """counts, samples and block sorts read the split sentences, and no inferred filter splits them again."""
    calls = spark.sparkContext.accumulator(0)

    def seen(text):
        calls.add(1)
        return text

    spark.conf.set("timedframe.maxGroupRows", "7")
    try:
        df = segs(spark, [(1, i, float(i), i + 1.0, "One here. Two there. Three.") for i in range(1, 21)])
        df = df.withColumn("text", F.udf(seen, "string")("text"))
        assert sg.split_sentences(df).count() == 60
        assert calls.value == 20
    finally:
        spark.conf.unset("timedframe.maxGroupRows")
