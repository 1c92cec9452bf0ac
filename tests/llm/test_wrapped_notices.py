"""Licence notices wrapped over lines."""

from __future__ import annotations

import textwrap

import pytest

from lucidex.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_notices(spark, prefix):
    cases = [(f, w, x) for f, x in (("MIT", MIT), ("BSD", BSD), ("ISC", ISC)) for w in (40, 60, 79)]
    body = lambda w, x: "\n".join(prefix + line for line in textwrap.wrap(x, w))
    rows = [(i, f"Some text first.\n{body(w, x)}\nAnd more.\n\nThe end.") for i, (_, w, x) in enumerate(cases)]
    rows += [(100 + i, x) for i, (_, _, x) in enumerate(cases)]
    half = body(60, MIT).split("\n")
    rows += [(200, f"{half[0]}\n\n{half[1]}"), (201, f"Licensed under the MIT License.\n\n{body(60, MIT)}\n\n{body(60, BSD)}"), (202, "Some text.\nOf no licence.\nPermission to park.\n")]
    found = {r["doc_id"]: r for r in licenses.document_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (family, _, _) in enumerate(cases):
        assert (found[i]["families"], found[i]["n_licences"]) == (family, 1)
        assert (found[100 + i]["families"], found[100 + i]["n_licences"]) == (family, 1)
    assert found[200]["n_licences"] == found[202]["n_licences"] == 0
    assert (found[201]["families"], found[201]["n_licences"]) == ("BSD,MIT", 3)
    each = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").collect()
    assert [(r["paragraph"], r["family"]) for r in each] == [(1, "MIT")]
