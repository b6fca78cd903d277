"""Every registered query against its SQL twin, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

import __spark_entry__ as registry
from check_oracles import compare


@pytest.mark.parametrize("name", registry.core_names())
def test_twin(spark, sf001, name):
    ok, n_rows, _, message = compare(spark, name, sf001)
    assert ok is not False, message
    if ok is None:
        assert name == "object_inventory" and n_rows > 0


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["doc_id", "text", "pii_types"] and df.count() == 200
