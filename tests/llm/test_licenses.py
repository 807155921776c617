import re

from tamarack.llm.licenses import known, rules, scan_licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software. The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
GPL = "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
CASES = {
    MIT: ["MIT"],
    GPL: ["GPL-3.0-or-later"],
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "x y\nThis work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"],
    "Licensed under CC BY-NC 4.0.": ["CC-BY-NC"],
    "Released under the MIT License. All rights reserved.": ["MIT", "Proprietary"],
    "He has a licence to drive, with permission.": [],
    "": [],
    None: [],
    "word " * 100_000 + "Released under the MIT License.": ["MIT"],
}


def test_licences(spark, make):
    texts = list(CASES)
    rows = scan_licenses(make(texts + texts[:1])).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r["licenses"] == CASES[(texts + texts[:1])[r["doc_id"]]]


def test_plan_is_native_and_empty_table(spark, make):
    assert not re.search("Python|Pandas|Arrow", scan_licenses(make([]))._jdf.queryExecution().toString())
    assert scan_licenses(make([])).count() == 0


GNU = "This {0} is free\nsoftware; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License\nas published by the Free Software Foundation; either version {2} of the License, or (at your option) any later\nversion."
WRAPPED = {
    GNU.format("program", "", "2"): ["GPL-2.0-or-later"],
    GNU.format("library", "Lesser ", "2.1"): ["LGPL-2.1-or-later"],
    "# This is free and unencumbered software released into the public\n# domain.": ["Unlicense", "Public-Domain"],
    "The work is dedicated to the public\ndomain.": ["Public-Domain"],
    "Text under CC\n * BY-SA 4.0.": ["CC-BY-SA"],
    "Text under creative\ncommons zero.": ["CC0-1.0"],
}


def test_wrapped_lines_and_gnu_headers(spark, make):
    texts = list(WRAPPED)
    for r in scan_licenses(make(texts)).collect():
        assert r["licenses"] == WRAPPED[texts[r["doc_id"]]], texts[r["doc_id"]]

BSD = """Copyright (c) 1998, The Regents of Somewhere. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
{}THIS SOFTWARE IS PROVIDED BY THE REGENTS ``AS IS'' AND ANY WARRANTIES ARE DISCLAIMED."""
THIRD = "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without permission.\n"
FORMS = {
    "SPDX-License-Identifier: MIT": ["MIT"],
    "// SPDX-License-Identifier: Apache-2.0\n#include <x>": ["Apache-2.0"],
    "# SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0-only"],
    "# SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
    "This file is subject to the terms of the Mozilla Public License, v. 2.0.": ["MPL-2.0"],
    "Mozilla Public License, v. 2.0": ["MPL-2.0"],
    "GPL v2.0 or later": ["GPL-2.0-or-later"],
    "BSD-3-Clause": ["BSD-3-Clause"],
    "Dual licensed under the MIT License and the GPLv3+.": ["MIT", "GPL-3.0-or-later"],
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": ["AGPL-3.0-only"],
    "Under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Licence.": ["CC-BY-NC-SA"],
    BSD.format(THIRD): ["BSD-3-Clause"],
    BSD.format(""): ["BSD-2-Clause"],
    "(c) Somebody, all rights reserved.": ["Proprietary"],
    "She studied under MIT professors and holds no licence.": [],
    "He prefers the MIT License to others, and free software to any.": [],
}


def test_forms_of_reference(spark, make):
    texts = list(FORMS)
    for r in scan_licenses(make(texts)).collect():
        assert r["licenses"] == FORMS[texts[r["doc_id"]]], (texts[r["doc_id"]], r)


def test_every_known_sentence_is_found_whole(spark, make):
    table = known()
    slots = {"the name may": "the name of X may", "provided by holder": "provided by X", "given to": "placed in", "copyright year": "copyright (c) 2001"}
    texts = []
    for s in table:
        s = s.replace("spdx ", "SPDX-License-Identifier: ")
        for form, first in slots.items():
            s = s.replace(form, first)
        texts.append(f"Some words before.\n{s.upper()}. Some words after.")
    for r in scan_licenses(make(texts)).collect():
        assert r["sentences"] == [list(table.values())[r["doc_id"]]], texts[r["doc_id"]]
    assert len({ids for _, ids in rules()}) == len(rules())


def test_columns_whose_names_clash(spark, make):
    docs = make(["Under the MIT License."]).selectExpr("doc_id AS sentences", "text", "1 AS __key", "2 AS licenses")
    assert scan_licenses(docs, "sentences").count() == 1
