"""Compression in few steps a file gives what its plain form gives."""

import random
import zlib

import pyarrow as pa
import pytest

from folioframe.functions.cos import PLAIN_OBJECT, Name, ParseError, Ref, Stream, parse, parse_indirect, references, renumbered, targets, write
from folioframe.functions.document import load
from folioframe.functions.filters import encode
from folioframe.functions.writing import write_file
from folioframe.operators import compression, writers
from folioframe.plans import queries as plans
from folioframe.sources import corpus, pdf


@pytest.mark.parametrize("lenient", [False, True])
@pytest.mark.parametrize("made", [corpus.customers, corpus.damaged, corpus.secrets, corpus.documents])
def test_counts(spark, sf, made, lenient):
    files = made(spark, sf).cache()
    want = pdf.objects(files, lenient).groupBy("file_id").count()
    assert sorted(map(tuple, pdf.object_counts(files, lenient).collect())) == sorted(map(tuple, want.collect()))


def test_only_counts_leave_the_last_pass(spark, sf):
    plan = plans.queries()["compress_objects"](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 3 and "raw#" not in plan and "refs#" not in plan


def test_files_leave_in_batches():
    class Files:
        schema = None

        def select(self, *_):
            return self

        def mapInArrow(self, emit, _):
            return emit

    rows = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([b"%d" % i if i else None for i in range(50)], pa.binary())], ["file_id", "content"])
    found = list(writers.each_content(Files(), lambda k, c: [(k, c), (k, None)])(iter([rows, rows])))
    assert len(found) == 2 and found[0].to_pylist() == [{"file_id": i, "content": c} for i in range(1, 50) for c in (b"%d" % i, None)]


ODD = [
    b"<</A/B/C 1 2 R/D 12/E[1 0 R 2 0 R]>>", b"<</A []/A 5/B[ ]>>", b"<< /A [1 0 R/B] /C [1 2 3] >>", b"<</A#20B 1/C/D#41>>", b"<</A 1.5/B -7/C +3/D(x)>>",
    b"<</A 1 % c\n/B 2>>", b"<</Length 3>>stream\nabc\nendstream", b"<</Length 9>> stream\r\nabc\r\nendstream", b"<</Length 3>> % c\nstream\nabc\nendstream",
    b"<</Length 3>>  % c\nstream\nabc", b"<</Length 3>>stream\nabc", b"<</A 1 0 Rx>>", b"<</A>>", b"<</A 1", b"<<>>", b"<</A-5/B>>", b"[1 0 R\x002 0 R]", b"<</A[1 0 R\x002\x000 R]>>", b"7", b"<</A<</B 1>>>>",
]


@pytest.mark.parametrize("body", ODD)
def test_plain_and_other_objects(body):
    found = load(write_file(*corpus._simple({Ref(20, 0): {"A": 0}, Ref(21, 0): {"B": 1}}, {})))
    for num in (20, 21):  # 21: another object is there
        at = len(found.data)
        found.data += b"20 0 obj\n" + body + b"\n"
        found.winners[num].offset = at
        try:
            value, _ = parse(body)
        except ParseError:
            value = None
        try:
            ref, read, _ = parse_indirect(found.data, at)
            assert ref == Ref(20, 0) and (read.dict if isinstance(read, Stream) else read) == value
        except ParseError:
            assert value is None or isinstance(value, dict) and b"stream" in body
        found.data += b" endobj\n"
    assert found.count_objects() == len(list(found.all_objects()))
    assert bool(PLAIN_OBJECT.match(b"1 0 obj<</A[1 0 R 2 0 R]/B/C>>"))


def test_what_surely_does_not_shrink():
    dice = random.Random(1)
    for n in range(15):
        for _ in range(3000):
            data = bytes(dice.choices(range(dice.choice((1, 2, 3, 5, 8, 256))), k=n))
            assert compression.may_shrink(data) or len(zlib.compress(data, 9)) >= n
    assert not compression.may_shrink(b"part 1234567") and encode(b"a" * 11, ["FlateDecode"]) < b"\xff" * 10 and compression.may_shrink(b"a" * 11)


def test_duplicates_are_those_of_all_bytes():
    dice = random.Random(2)
    values = lambda: dice.choice([1, Name("A"), Ref(dice.randrange(40), 0), [Ref(dice.randrange(3), 0)], b"s"])
    for _ in range(200):
        objects = {Ref(i, 0): {k: values() for k in "ABCD"[: dice.randrange(5)]} for i in range(40)}
        objects |= {Ref(i, 0): Stream({"R": Ref(dice.randrange(3), 0)} | {"T": dice.randrange(2)}, b"x" * dice.randrange(2)) for i in range(40, 60)}
        first, new = {}, {}
        for ref in sorted(objects):
            value = objects[ref]
            assert targets(value) == [Ref(n, g) for _, n, g in references(value)]
            if isinstance(value, Stream) or len(value) >= 4:
                if (same := first.setdefault(write(value), ref)) != ref:
                    new[ref] = same
        assert compression.deduplicated(objects) == {r: renumbered(v, new) for r, v in objects.items() if r not in new}
