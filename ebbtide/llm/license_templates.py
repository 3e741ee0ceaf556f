"""License notices found by matching template markup.

A template is wording with optional parts, `<<beginOptional>> ... <<endOptional>>`,
and replaceable parts, `<<var;match=N>>`, up to N words of any kind. It is
compiled to an automaton over words: mandatory words must stand in their order,
an optional part may be skipped whole, a replaceable part takes any words up to
its length. Upper and lower case and everything between words don't count. A
place matches where the automaton, started there, reaches its end; of several
ends the first counts.

Base phrases (consecutive words) are found beside them. Words are runs of ASCII
letters and digits and of any characters from U+0080 on, A-Z lower-cased.

Cases: a null text counts as empty, with no words and no labels; texts of any
length are read whole; equal rows give equal rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ebbtide.llm.batches import WORD_BYTE, map_text, utf8

# Phrases and labels of the base.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# The wording of published licenses and their usual notices, with markup of our own.
TEMPLATES = {
    "cc-by-4.0": "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4.0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by-sa <<beginOptional>>license<<endOptional>> <<beginOptional>>version<<endOptional>> 4.0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by-nc <<beginOptional>>license<<endOptional>> <<beginOptional>>version<<endOptional>> 4.0",
    "cc-by-nd-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by-nd <<beginOptional>>license<<endOptional>> <<beginOptional>>version<<endOptional>> 4.0",
    "creative-commons": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution <<var;match=6>> license",
    "cc0-1.0": "<<beginOptional>>creative commons<<endOptional>> cc0 1.0 universal",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>",
    "mit": "<<beginOptional>>this <<var;match=2>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted <<beginOptional>>provided that the above copyright notice and this permission notice appear in all copies<<endOptional>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "copyright-reserved": "copyright <<beginOptional>>c<<endOptional>> <<var;match=8>> all rights reserved",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;match=(\d+))>>")


@dataclass(frozen=True)
class Automaton:
    """States are numbers; ``step`` maps a state and a word to states, ``free`` to those that any word leads to."""

    first: frozenset[int]
    step: dict[tuple[int, bytes], frozenset[int]]
    free: dict[int, frozenset[int]]
    end: int
    starts: frozenset[bytes]
    needed: tuple[bytes, ...]  # mandatory words

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end (exclusive) of the first match that starts at a word, or None."""
        now = self.first
        for place in range(at, len(words)):
            after: set[int] = set()
            for state in now:
                after |= self.step.get((state, words[place]), frozenset()) | self.free.get(state, frozenset())
            if self.end in after:
                return place + 1
            if not after:
                return None
            now = after
        return None


def compile_template(markup: str) -> Automaton:
    """Word and variable edges between numbered states, then empty moves of the optional parts are folded in."""
    edges: list[tuple[int, bytes | None, int]] = []  # None: any word
    empty: list[tuple[int, int]] = []
    state, opened, needed, place = 0, [], [], 0

    def words(text: str):
        nonlocal state
        for word in WORD.findall(text.lower().encode()):
            edges.append((state, word, state + 1))
            state += 1
            if not opened:
                needed.append(word)

    for mark in _MARK.finditer(markup):
        words(markup[place : mark.start()])
        place = mark.end()
        if mark[1] == "beginOptional":
            opened.append(state)
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError(f"an optional part ends that doesn't begin: {markup[:60]}")
            empty.append((opened.pop(), state))
        else:
            begin = state
            for _ in range(int(mark[2])):
                edges.append((state, None, state + 1))
                state += 1
            empty += [(k, state) for k in range(begin, state)]
    words(markup[place:])
    if opened or not needed:
        raise ValueError(f"an optional part doesn't end, or no word is mandatory: {markup[:60]}")

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            s = todo.pop()
            for a, b in empty:
                if a == s and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    step: dict[tuple[int, bytes], frozenset[int]] = {}
    free: dict[int, frozenset[int]] = {}
    for a, word, b in edges:
        if word is None:
            free[a] = free.get(a, frozenset()) | closure([b])
        else:
            step[a, word] = step.get((a, word), frozenset()) | closure([b])
    first = closure([0])
    if any(s in free for s in first):
        raise ValueError(f"a template can't begin with a replaceable part: {markup[:60]}")
    return Automaton(first, step, free, state, frozenset(w for (s, w) in step if s in first), tuple(dict.fromkeys(needed)))


class Matcher:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.phrases = {tuple(p.encode().split()): label for p, label in phrases.items()}
        # a text without the longest mandatory word of a template or phrase can't match it
        self.rare = {label: max(a.needed, key=len) for label, a in self.automata.items()}
        self.gap = {p: re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[^0-9a-z\x80-\xff]+".join(map(re.escape, p)) + rb"(?![0-9a-z\x80-\xff])") for p in self.phrases}
        self.begin: dict[bytes, list[str]] = {}
        for label, a in self.automata.items():
            for word in a.starts:
                self.begin.setdefault(word, []).append(label)

    def base(self, text: bytes) -> list[tuple[int, str]]:
        """Byte places and labels of base phrases; no phrase can overlap itself."""
        return [(m.start(), label) for phrase, label in self.phrases.items() if max(phrase, key=len) in text for m in self.gap[phrase].finditer(text)]

    def found(self, text: bytes) -> list[tuple[str, int, int]]:
        """Label, first word and end word of every template match."""
        possible = {label for label, word in self.rare.items() if word in text}
        possible = {label for label in possible if all(w in text for w in self.automata[label].needed)}
        if not possible:
            return []
        words = WORD.findall(text)
        out = []
        for place, word in enumerate(words):
            for label in self.begin.get(word, ()):
                if label in possible and (end := self.automata[label].match(words, place)) is not None:
                    out.append((label, place, end))
        return out


_matchers: dict = {}


def _matcher(templates: dict[str, str], phrases: dict[str, str]) -> Matcher:
    key = (tuple(templates.items()), tuple(phrases.items()))
    if key not in _matchers:
        _matchers[key] = Matcher(templates, phrases)
    return _matchers[key]


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """``keep`` columns, word and phrase counts, labels, and the matched templates with their word spans.

    ``score``: 1 where a template matches, 0.5 where only a phrase does, else 0.
    """
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("matches", T.StringType()),
    ]

    def work(piece, matcher):
        data, offsets = utf8(piece.column("text"))
        is_word = np.concatenate([[False], WORD_BYTE[data], [False]])
        begins = is_word[1:-1] & ~is_word[:-2] if len(data) else np.zeros(0, bool)
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = is_word[1:-1][heads]
        starts = np.flatnonzero(begins)
        first = np.searchsorted(starts, offsets)
        held = data.tobytes().lower()  # of bytes: A-Z only
        columns = [[] for _ in fields]
        for i in range(len(piece)):
            own = held[offsets[i] : offsets[i + 1]]
            base = matcher.base(own)
            places = np.searchsorted(starts, [offsets[i] + p for p, _ in base]) - first[i]
            spans = matcher.found(own)
            plain = {label for _, label in base}
            row = (
                int(first[i + 1] - first[i]),
                len(base),
                int(places.min()) if base else None,
                int(places.max()) if base else None,
                ",".join(sorted(plain)),
                ",".join(sorted(plain | {s[0] for s in spans})),
                1.0 if spans else 0.5 if base else 0.0,
                ",".join(f"{label}:{a}:{b}" for label, a, b in spans),
            )
            for c, v in zip(columns, row):
                c.append(v)
        return columns

    return map_text(docs, keep, text, fields, work, lambda: _matcher(templates, phrases))
