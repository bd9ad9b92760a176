"""Notices wrapped over several lines."""

import random
import textwrap

import pytest

from folioscope.llm import licences

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
NOTICES = {"MIT": MIT, "GPL-3.0": GPL, "BSD": BSD, "ISC": ISC, "Apache-2.0": APACHE}


@pytest.mark.parametrize("width", [40, 72, 80])
def test_wrapped_notices(spark, table, width):
    rng = random.Random(width)
    prose = lambda k: "\n".join(textwrap.wrap(" ".join(rng.choices(["the", "tree", "went", "over", "hills", "and", "she", "driving", "work", "use"], k=k)), width))
    data = []
    for i, notice in enumerate(NOTICES.values()):
        wrapped = textwrap.wrap(notice, width)
        data += [
            (10 * i, f"{prose(30)}\n\n" + "\n".join(wrapped) + f"\n\n{prose(40)}"),
            (10 * i + 1, "/*\n * " + "\n * ".join(wrapped) + "\n */\n" + prose(60)),
            (10 * i + 2, f"{prose(300)}\n" + "\n".join(wrapped) + f"\n{prose(300)}"),
        ]
    data += [(500, prose(500)), (501, prose(30) + "\n\n" + prose(200))]
    got = {r.row.doc_id: r for r in licences.scan(table(data)).collect()}
    for i, family in enumerate(NOTICES):
        for k in range(3):
            confirmed = [f for f in got[10 * i + k].flagged if f.confirmed]
            assert [f.family for f in confirmed] == [family], (family, k)
    assert got[500].flagged == got[501].flagged == []
    first = next(f for f in got[0].flagged if f.confirmed)
    assert first.lines > 1 and first.paragraph >= len(prose(30).split("\n")) - 1


def test_sums_of_stretches():
    model = licences.train(40, 30)
    import numpy as np

    text = "\n".join([*textwrap.wrap(MIT, 50), "", *textwrap.wrap(GPL, 30)]).encode()
    data = np.frombuffer(text, np.uint8)
    lines = np.unique(np.concatenate([[0, len(data)], np.flatnonzero(data == 10) + 1]))
    words = licences.Words.of(data, lines, model)
    for a, b in ((0, 3), (1, 2), (2, 6)):
        part = data[lines[a] : lines[b]]
        gram, line, n = licences._grams(part, np.array([0, len(part)]))
        got = words.sums(model.weight, np.array([a]), np.array([b])) / np.sqrt(2 * n - 1) + model.bias
        assert np.allclose(got, model.logits(gram, line, n), atol=1e-5)


def test_unknown_families():
    """Licences that no template names are unknown, those that templates name are not."""
    import numpy as np

    model = licences.train()

    def said(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        p = model.probabilities(model.logits(*licences._grams(raw, np.array([0, len(raw)]))))[0]
        k = int(p.argmax())
        return licences.CLASSES[k] if licences.CLASSES[k] in ("none", "unknown") or p[k] >= licences.CONFIDENT else "unknown"

    strangers = (
        "Licensed under the Eclipse Public License 2.0", "Licensed under the EUPL", "Released under the zlib License", "Licensed under the Artistic License 2.0",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1", "Distributed under the Boost Software License, Version 1.0", "Released under the Acme Community License",
    )
    assert [said(x) for x in strangers] == ["unknown"] * len(strangers)
    assert all(said(t) == family for family, texts in licences.TEMPLATES.items() for t in texts)
