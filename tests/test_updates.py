"""Many updates at once are those of one after the other, and load the file once."""

import pytest

from folioframe.functions import writing
from folioframe.functions.cos import Ref
from folioframe.sources import corpus


@pytest.mark.parametrize("xref", ["table", "stream"])
def test_updates(monkeypatch, xref):
    data = writing.write_file(*corpus._simple({Ref(20, 0): {"A": 0}}, {}), xref=xref, packed=xref == "stream")
    updates = [{Ref(20 + i % 3, 0): {"A": i}, Ref(30, 0): {"B": i}} for i in range(7)]
    one_by_one = data
    for changes in updates:
        one_by_one = writing.write_update(one_by_one, changes)
    assert writing.write_updates(data, updates) == one_by_one


def test_a_form_is_loaded_once(monkeypatch):
    loads, load = [], writing.load
    monkeypatch.setattr(writing, "load", lambda *a, **k: loads.append(1) or load(*a, **k))
    corpus.form_pdf({"events": [{"ts": i, "event_id": i, "event_type": f"t{i % 2}"} for i in range(20)]})
    assert len(loads) == 1
