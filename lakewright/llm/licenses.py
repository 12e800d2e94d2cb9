"""Operator 3: licence scans by a generalised suffix automaton.

The automaton holds the words of every licence template and of the base phrases. A file's words are
streamed through it, which gives at each word the longest match that ends there (matching statistics).
Places of a base phrase are the words whose match has the phrase as a suffix: the phrase's state is an
ancestor by suffix links. Long matches are chained in template order into covered spans; a template that
is covered far enough adds its label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns, words

#: Phrase -> label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label -> text of a licence or of its usual notice (public texts).
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


class SuffixAutomaton:
    """Of several word sequences: states, suffix links, and where each state's words end in a sequence."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for t, seq in enumerate(texts):
            last = 0
            for pos, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, pos)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for t, pos in self.ends[s].items():
                up = self.ends[self.link[s]]
                up[t] = min(up.get(t, pos), pos)

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def find(self, seq: list[int]) -> int:
        s = 0
        for w in seq:
            s = self.next[s][w]
        return s


class Scanner:
    """The automaton of templates and phrases, and what each state says of the phrases."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        texts = [(p.split(), k) for p, k in phrases.items()] + [(t.split(), k) for k, t in templates.items()]
        self.vocab = {w: i for i, w in enumerate(sorted({x for t, _ in texts for x in t}))}
        self.code = {w.encode(): i for w, i in self.vocab.items()}
        self.size, self.label = [len(t) for t, _ in texts], [k for _, k in texts]
        self.n_phrases = len(phrases)
        self.least = min(map(len, (t for t, _ in texts)))
        coded = [[self.vocab[w] for w in t] for t, _ in texts]
        self.a = a = SuffixAutomaton(coded)
        ending: list[list[int]] = [[] for _ in a.link]
        own = {a.find(coded[i]): i for i in range(self.n_phrases)}
        for s in sorted(range(1, len(a.link)), key=lambda s: a.length[s]):
            ending[s] = [*ending[a.link[s]], *([own[s]] if s in own else [])]
        self.ending = ending

    def statistics(self, w: list[int], at: int):
        """(place, state, length of the longest match that ends there) for a run of known words."""
        nxt, link, length = self.a.next, self.a.link, self.a.length
        s = n = 0
        for i, x in enumerate(w, at):
            while s and x not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s].get(x, 0)
            n = n + 1 if s else 0
            yield i, s, n

    def scan(self, text: bytes, long_match: int, least_cover: float) -> tuple:
        """n_words, places [(start, phrase)], {template: (covered share, first word, last word)}."""
        w = words(text)
        ids = np.fromiter(map(self.code.get, w, [-1] * len(w)), np.int32, len(w))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= self.least
        places, matches = [], []
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            before = (0, 0, 0)
            for i, s, n in self.statistics(ids[a:b].tolist(), a):
                for p in self.ending[s]:
                    if self.size[p] <= n:
                        places.append((i - self.size[p] + 1, p))
                if n <= before[2] and before[2] >= long_match:
                    matches.append(before)
                before = (i, s, n)
            if before[2] >= long_match:
                matches.append(before)
        return len(w), places, self.chained(matches, least_cover)

    def chained(self, matches: list[tuple], least_cover: float) -> dict[int, tuple]:
        """The best chain for each template: matches in order of text and template, by covered words."""
        found: dict[int, list] = {}
        for i, s, n in matches:
            for t, end in self.a.ends[s].items():
                if t >= self.n_phrases:
                    found.setdefault(t, []).append((i - n + 1, i, end - n + 1, end))
        out = {}
        for t, own in found.items():
            best: list[tuple] = []  # (template end, text end) -> covered, first word; the best of each template end
            top = (0, 0, 0)
            for a, b, ta, tb in own:
                cover, first = b - a + 1, a
                for e, te, c, f in best:
                    if e < ta and te < a and a - te <= 2 * self.size[t] and c + b - a + 1 > cover:
                        cover, first = c + b - a + 1, f
                best = [x for x in best if x[0] != tb or a - x[1] <= 2 * self.size[t] and x[2] > cover]
                best.append((tb, b, cover, first))
                top = max(top, (cover, -first, b))
            if top[0] >= least_cover * self.size[t]:
                out[t] = (top[0] / self.size[t], -top[1], top[2])
        return out


_scanners: dict[tuple, Scanner] = {}


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    long_match: int = 4,
    least_cover: float = 0.6,
) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels,
    score, and spans (label, share covered, first and last word of each covered template).

    long_match: words of the shortest match that is chained. least_cover: share of a template's words
    from which its label counts. score: 1 with a base place, else the best share of any template.
    Null counts as empty: no words, no labels, score 0, no first and last word. Rows are independent:
    repeated rows repeat, an empty table gives an empty one, further columns are ignored.
    """
    key = (tuple(phrases.items()), tuple(templates.items()))

    def run(doc_ids: list, texts: list) -> list:
        if key not in _scanners:
            _scanners[key] = Scanner(phrases, templates)
        sc, out = _scanners[key], []
        for i, t in zip(doc_ids, texts, strict=True):
            n, places, covered = sc.scan(t or b"", long_match, least_cover)
            base = {sc.label[p] for _, p in places}
            more = base | {sc.label[t] for t in covered}
            starts = [a for a, _ in places]
            score = 1.0 if places else min(1.0, max((x[0] for x in covered.values()), default=0.0))
            cover = [{"label": sc.label[t], "share": x[0], "first": x[1], "last": x[2]} for t, x in covered.items()]
            out.append((
                i, n, len(places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(more)), score, cover,
            ))
        return list(zip(*out, strict=True))

    return map_columns(
        docs, ["doc_id", "text"], run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, share: double, first: long, last: long>>",
        pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))),
        ]),
    )
