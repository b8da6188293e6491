"""job16_matched_pairs and job16_pair_properties leave two orders by range, rows, bidders, objects and the last state; what else their rounds wrote is gone."""

import os

from evalmill.operators.order import shared_folder
from evalmill.plans import source_queries


def tables_left(spark, run):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = run().collect()
    return rows, len(set(os.listdir(folder)) - before)


def test_matched_pairs(spark, sf_dir):
    rows, left = tables_left(spark, lambda: source_queries.job16(spark, sf_dir))
    assert len(rows) == 2 * len({r["pair_id"] for r in rows}) == len({r["vec_id"] for r in rows}) and left <= 6


def test_pair_properties(spark, sf_dir):
    rows, left = tables_left(spark, lambda: source_queries.job16_properties(spark, sf_dir))
    assert rows[0]["n_ids"] == rows[0]["n_rows"] == 2 * rows[0]["n_pairs"] and rows[0]["one_of_each_label"] and left <= 6
