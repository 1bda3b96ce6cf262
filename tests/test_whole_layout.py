"""Layout queries take whole texts: fixtures longer than 1500 characters and 200 words."""

import random

import pandas as pd
import pytest
from oracle import duck_rows, spark_rows

from textloom.plans import catalogue

BOXED = ["box_overlaps", "spatial_argmax", "line_islands", "widest_gap", "reading_order", "bounding_boxes", "free_width", "list_label_runs", "rotated_pages", "page_gutters", "cell_assignment"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(11)
    word = lambda: "x" * r.choice([1, 2, 3, 5, 8, 9, 10, 11, 14, 19])
    texts = [" ".join(word() for _ in range(n)) for n in (700, 431, 260, 30, 1)] + [""]
    d = tmp_path_factory.mktemp("layout")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(d / "documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", BOXED)
def test_whole_texts(spark, folder, name):
    assert spark_rows(catalogue.queries()[name](spark, folder)) == duck_rows(folder, catalogue.oracle_sql()[name])


def test_connected_rules_of_whole_pages(spark, folder):
    from textloom.plans.layout import boxes

    rows, brute = [tuple(r) for r in boxes(spark, folder).select("page", "id", "x0", "y0", "x1", "y1").collect()], {}
    for page in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == page)
        label = [r[0] for r in mine]
        for _ in mine:
            new = [min(label[k] for k, b in enumerate(mine) if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]) for a in mine]
            if new == label:
                break
            label = new
        brute |= {(page, r[0]): g for r, g in zip(mine, label, strict=True)}
    found = {(r.page, r.id): r.grid for r in catalogue.queries()["connected_rules"](spark, folder).collect()}
    assert found == brute and len(found) == 700 + 431 + 260 + 30 + 1
