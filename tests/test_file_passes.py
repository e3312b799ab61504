"""Queries over one file's own objects: one pass over the files, with the rows of the table operators."""

import pytest

from folioframe.functions.cos import Hex, Name, ParseError, Ref, parse, write
from folioframe.operators import graph, images
from folioframe.plans import queries as plans
from folioframe.sources import corpus, pdf


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, sf):
    files = corpus.customers(spark, sf).cache()
    return files, pdf.objects(files).cache()


def test_duplicates(tables):
    files, found = tables
    want = rows(graph.duplicates(found))
    assert want and rows(graph.file_duplicates(files)) == want


def test_reachable(tables):
    files, found = tables
    want = rows(graph.reachable(found.where("type = 'Catalog'"), pdf.refs(found)).join(found.select("file_id", "obj_num"), ["file_id", "obj_num"]))
    assert want and rows(graph.file_reachable(files).where("live").drop("live")) == want


def test_reference_counts(tables):
    files, found = tables
    assert rows(graph.file_reference_counts(files).drop("type")) == rows(graph.reference_counts(found, pdf.refs(found)))


@pytest.mark.parametrize("name", ["object_dedup", "reachable_objects", "reference_counts"])
def test_files_are_made_and_read_once(spark, sf, name):
    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join") == 1  # made, read; orders with their lines


def test_dictionaries():
    value = {"A": Ref(1, 0), "B": -5, "C": Name("D"), "E F": Name("x#"), "G": [Ref(2, 1), 3, {"H": None}], "I": 1.5, "J": b"s", "K": Hex(b"h"), "L": True}
    assert parse(write(value)) == (value, len(write(value)))
    assert parse(b"<</A/B/C 1 2 R/D 12/E 1%c\n/F +3/G 1 0 R % x\n/A 4>>")[0] == {"A": 4, "C": Ref(1, 2), "D": 12, "E": 1, "F": 3, "G": Ref(1, 0)}
    assert type(parse(b"<</A/B>>")[0]["A"]) is Name and write({"A": True}) == b"<< /A true >>"
    for bad in (b"<</A 1 2 Rx>>", b"<</A/B", b"<</A foo>>"):
        with pytest.raises(ParseError):
            parse(bad)


@pytest.mark.parametrize("made", [corpus.images, corpus.layered_images])
def test_images(spark, sf, made):
    files = made(spark, sf)
    columns = images.image_table(pdf.objects(files)).columns
    plain = lambda df: sorted(map(repr, df.select(columns).collect()))
    want = plain(images.image_table(pdf.objects(files)))
    assert want and plain(images.file_image_table(files)) == want


@pytest.mark.parametrize("name", ["image_inventory", "image_layers"])
def test_no_image_is_joined(spark, sf, name):
    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan
