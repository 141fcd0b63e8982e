"""License scan: fuzzy search for short notices.

A notice of m characters with at most k edits, cut into k + 1 seeds, keeps one seed unharmed (pigeonhole). One
automaton over the seeds of all notices gives the candidate windows; the regex library's bounded-error matching then
verifies each window and reports span and edits. The words that tell licenses apart must stand unharmed: an edit that
turns one license's notice into another's is none. Base labels come from exact phrases of words; the search adds its
own labels and never removes a base one.

Defined results: a null text counts as empty (no words, empty labels, score 0); repeated rows give repeated results;
an empty table gives no rows; only doc_id and text are looked at. Words are found on UTF-8 bytes: A-Z lower-cased,
everything of ASCII but letters and digits separates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_pass

#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Licenses by the words of their name, which stand in short notices of the same form. Every word of a name must be there.
NAMES = {
    "mit": "mit", "bsd": "bsd", "isc": "isc", "x11": "x11", "zlib": "zlib", "apache": "apache", "artistic": "artistic",
    "mozilla public": "mpl", "eclipse public": "epl", "boost software": "bsl", "gnu general public": "gpl",
    "gnu lesser general public": "lgpl", "gnu affero general public": "agpl",
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl",
}
FORMS = ("released under the {} license", "licensed under the {} license", "distributed under the {} license")
#: Creative Commons by the words after "by".
COMMONS = ("", "nc", "sa", "nd", "nc sa", "nc nd")
#: Opening lines and grants of common licenses, as words, with the words that no edit may touch and the label.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted", "mit"),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("you may not use this file except in compliance with the license", "compliance license", "apache"),
    ("licensed under the gnu general public license version 3", "gnu general public", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public", "gpl"),
    ("under the terms of the gnu lesser general public license", "gnu lesser general public", "lgpl"),
    ("under the terms of the gnu affero general public license", "gnu affero general public", "agpl"),
    ("creative commons attribution 4 0 international license", "commons attribution", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international license", "attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "attribution sharealike", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution source binary", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "permission distribute", "isc"),
    ("this is free and unencumbered software released into the public domain", "unencumbered", "unlicense"),
    ("do what the fuck you want to public license", "want public", "wtfpl"),
    ("this software is provided as is without any express or implied warranty", "express implied", "zlib"),
)


def _notices() -> tuple[tuple[str, str, str], ...]:
    named = [(form.format(name), name, label) for name, label in NAMES.items() for form in FORMS]
    commons = [
        (" ".join(["licensed under cc by", *kind.split(), "4 0"]), f"cc by {kind}".strip(), "-".join(["cc-by", *kind.split()]))
        for kind in COMMONS
    ]
    return (*named, *commons, *TEXTS)


#: notice, telling words, label.
NOTICES = _notices()
#: One edit is allowed for so many characters of a notice, and so many edits at most.
CHARS_PER_EDIT, MOST_EDITS = 12, 3
COLUMNS = (
    "doc_id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,"
    "score double,spans string"
)
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _whole_words(text: bytes, start: int, end: int) -> list[bytes]:
    """The words of the stretch that it does not cut."""
    if start and text[start - 1 : start] != b" ":
        start = text.find(b" ", start, end)
    if end < len(text) and text[end : end + 1] != b" ":
        end = text.rfind(b" ", start, end)
    return text[start:end].split() if 0 <= start < end else []


def _overlapping(hits: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each hit with those that overlap it; hits by start. Notices are short, so each looks at a few neighbours only."""
    longest = max((end - start for _, start, end, _, _ in hits), default=0)
    first = 0
    for i, hit in enumerate(hits):
        while hits[first][1] <= hit[1] - longest:
            first += 1
        last = i
        while last < len(hits) and hits[last][1] < hit[2]:
            last += 1
        yield hit, [x for x in hits[first:last] if x is not hit and hit[1] < x[2]]


class NoticeSearch:
    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = [
            (text.encode(), label, min(MOST_EDITS, max(1, len(text) // chars_per_edit)), Counter(telling.encode().split()))
            for text, telling, label in notices
        ]
        self.patterns = [
            regex.compile(rb"(?e)(?:%s){e<=%d}" % (regex.escape(text), k)) for text, _, k, _ in self.notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, k, _) in enumerate(self.notices):
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b].decode("latin-1"), []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def windows(self, text: bytes) -> dict[int, list[list[int]]]:
        """By notice: the stretches of text that hold every match, overlapping ones joined."""
        found: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.automaton.iter(text.decode("latin-1")):
            for n, offset in uses:
                notice, _, k, _ = self.notices[n]
                start = end + 1 - length - offset
                a, b = max(0, start - k), min(len(text), start + len(notice) + k)
                own = found.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        return found

    def search(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """label, start, end, edits, length of the notice; text: lower-case words with single spaces.

        Every telling word of a notice stands unharmed in a match. Of matches that overlap, those with more edits than
        another give way.
        """
        out = []
        for n, windows in self.windows(text).items():
            notice, label, _, telling = self.notices[n]
            for a, b in windows:
                while m := self.patterns[n].search(text, a, b):
                    a = m.start() + 1
                    if not telling - Counter(_whole_words(text, *m.span())):
                        out.append((label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)))
                        a = m.end()
        out.sort(key=lambda x: (x[1], x[2], x[0]))
        return [hit for hit, others in _overlapping(out) if not any(x[3] < hit[3] for x in others)]


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, text -> COLUMNS. spans: label:first word:last word:edits of every verified notice. No shuffle."""
    wanted = [(tuple(p.encode().split()), label) for p, label in phrases.items()]

    def make() -> Callable:
        search = NoticeSearch(notices, chars_per_edit)
        whole = [(b" " + b" ".join(words) + b" ", label) for words, label in wanted]

        def work(doc_ids, texts):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                words = (text or "").encode().translate(_WORDS).split()
                joined = b" ".join(words)
                padded = b" " + joined + b" "
                starts, base = [], set()
                for phrase, label in whole:
                    at = padded.find(phrase)
                    while at >= 0:
                        starts.append(at)
                        base.add(label)
                        at = padded.find(phrase, at + 1)
                hits = search.search(joined)
                score = 1.0 if base else max((1 - h[3] / h[4] for h in hits), default=0.0)
                yield (
                    doc_id,
                    len(words),
                    len(starts),
                    padded.count(b" ", 0, min(starts)) if starts else None,
                    padded.count(b" ", 0, max(starts)) if starts else None,
                    ",".join(sorted(base)),
                    ",".join(sorted(base | {h[0] for h in hits})),
                    score,
                    ",".join(
                        f"{h[0]}:{joined.count(b' ', 0, h[1])}:{joined.count(b' ', 0, h[2])}:{h[3]}" for h in hits
                    ),
                )

        return work

    return text_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
