import duckdb
import pandas as pd

from paperloom.llm.licenses import license_sql, scan_licenses

ROWS = [
    (1, "Some text.\nReleased under the MIT License.\nMore. MIT license, mit LICENSE"), (2, None), (3, ""), (4, "License"), (5, "mit"),
    (6, "GNU General Public License general public license apache-license"), (7, "x " * 50 + "Licensed under CC BY-NC 4.0. " + "y " * 200),
    (8, "This source code form subject to the terms of the Mozilla Public License"), (None, "Apache License"), (9, "été license mit license"),
    (10, "word " * 20_000 + "general public license"), (11, "released under the licence"), (11, "the MIT License"), (11, "the MIT License"),
    (12, "Licensed under the Apache License, Version 2.0."), (13, "public license"), (14, "license mit license license"),
]


def test_odd_documents_match_all_blocks_with_all_templates(spark):
    docs = spark.createDataFrame([(*row, "x", "y") for row in ROWS], "doc_id long, text string, word string, share string")
    got = scan_licenses(docs.repartition(3)).collect()
    documents = pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(license_sql()).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(*row[:7], float(row[7])) for row in want]))
    by_id = {row.doc_id: row for row in got}
    assert by_id[1].labels == "mit" and by_id[1].n_base == 3 and by_id[1].first_word == 5
    assert by_id[7].labels == "cc-by-nc" and by_id[7].base_labels == "" and by_id[7].score == 1.0
    assert by_id[8].labels == "mpl" and by_id[8].score < 1
    assert scan_licenses(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_sentences_wrapped_over_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    filler = "some other words here\n" * 40
    rows = [(1, mit), (2, bsd), (3, filler + mit + "\n" + filler), (4, "# " + bsd.replace("\n", "\r\n# ")), (5, filler)]
    got = {row.doc_id: (row.labels, row.score) for row in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("mit", 1.0), 4: ("bsd", 1.0), 5: ("", 0.0)}
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    said = {row[0]: (row[6], float(row[7])) for row in duckdb.sql(license_sql()).fetchall()}
    assert said == got
