"""License scans by template markup: notices with optional and replaceable regions, compiled to automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import table
from aislewatch.llm.words import ALNUM, Words, text_pieces, windows

# The phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licence notices. [a b] may be left out; {2-5} stands for two to five words of any kind.
TEMPLATES = {
    "mit-notice": "{1-1} under the [terms of the] mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction {0-80} the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",
    "apache-notice": "{1-1} under the [terms of the] apache license [version 2 0]",
    "apache-grant": "licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license [you may obtain a copy of the license at {1-12}]",
    "gpl-notice": "{1-1} under the [terms of the] gnu [lesser] general public license [version {1-1}]",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1-1} of the license or at your option any later version",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-notice": "licensed under a creative commons attribution {0-4} license",
    "cc-short": "licensed under cc by [nc] [sa] [nd] {1-1} {1-1}",
    "rights-reserved": "copyright {1-8} all rights reserved",
}

_PART = re.compile(r"\[|\]|\{(\d+)-(\d+)\}|[^\s\[\]{}]+")


class Automaton:
    """A template as states 0..n with steps (state, word or None for any word, next state) and jumps without a word.

    ``anchor``: the longest run of words that no text can do without; only texts that hold it are run through.
    """

    def __init__(self, markup: str):
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.jumps: list[list[int]] = [[]]
        at, opened, runs = 0, [], [[]]

        def new() -> int:
            self.steps.append([])
            self.jumps.append([])
            return len(self.steps) - 1

        for part in _PART.finditer(markup):
            if part[0] == "[":
                opened.append(at)
                runs.append([])
            elif part[0] == "]":
                self.jumps[opened.pop()].append(at)
                runs.append([])
            elif part[1] is not None:
                least, most = int(part[1]), int(part[2])
                skip = []
                for k in range(most):
                    if k >= least:
                        skip.append(at)
                    to = new()
                    self.steps[at].append((None, to))
                    at = to
                for s in skip:
                    self.jumps[s].append(at)
                runs.append([])
            else:
                to = new()
                self.steps[at].append((part[0].encode(), to))
                at = to
                if opened:
                    runs.append([])
                else:
                    runs[-1].append(part[0].encode())
        self.end, self.anchor = at, max(runs, key=len)

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.jumps[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, words: list[bytes], start: int) -> int:
        """The end of the longest run of words from ``start`` on that the template accepts; -1 if there is none."""
        states, found = self.close({0}), -1
        for i in range(start, len(words) + 1):
            if self.end in states:
                found = i
            if i == len(words):
                break
            states = self.close({to for s in states for w, to in self.steps[s] if w is None or w == words[i]})
            if not states:
                break
        return found

    def furthest(self) -> int:
        """The most words that can come before the anchor."""
        depth = {0: 0}
        for s in range(len(self.steps)):
            for t in [to for _, to in self.steps[s]]:
                depth[t] = max(depth.get(t, 0), depth[s] + 1)
            for t in self.jumps[s]:
                depth[t] = max(depth.get(t, 0), depth[s])
        return depth[self.end]


def template_regex(markup: str) -> str:
    """The template as a regular expression over words joined by single spaces, with one space before each."""
    out = ""
    for part in _PART.finditer(markup):
        if part[0] == "[":
            out += "(?:"
        elif part[0] == "]":
            out += ")?"
        elif part[1] is not None:
            out += f"(?: [^ ]+){{{part[1]},{part[2]}}}"
        else:
            out += f" {part[0]}"
    return out + "(?: |$)"


def _hash(words: list[bytes]) -> np.uint64:
    flat = b" ".join(words)
    h = Words(np.frombuffer(flat, np.uint8), np.array([0, len(flat)]), ALNUM).hashes()
    return windows(h, np.array([0]), len(words))[0]


def _scan(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    machines = {k: Automaton(m) for k, m in templates.items()}
    reach = {k: m.furthest() for k, m in machines.items()}
    wanted = [(p.encode().split(), label, None) for p, label in phrases.items()] + [(m.anchor, k, m) for k, m in machines.items()]
    keys = [_hash(words) for words, _, _ in wanted]
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
    for batch in batches:
        for a, b, buf, off in text_pieces(batch.column(1)):
            w = Words(buf, off, ALNUM)
            h = w.hashes()
            found = [{"places": [], "base": set(), "spans": {}} for _ in range(b - a)]
            for (words, label, machine), key in zip(wanted, keys, strict=True):
                m = len(words)
                first = np.flatnonzero(_starts(h, words))
                if m > 1 and len(first):
                    first = first[windows(h, first, m) == key]
                for p in first.tolist():
                    d = int(w.doc[p])
                    if p + m > w.first[d + 1] or any(w.word(p + j) != x for j, x in enumerate(words)):
                        continue
                    if machine is None:
                        found[d]["places"].append(p - int(w.first[d]))
                        found[d]["base"].add(label)
                        continue
                    lo, hi = max(int(w.first[d]), p - reach[label]), min(int(w.first[d + 1]), p + reach[label] + 1)
                    near = [w.word(i) for i in range(lo, hi)]
                    for s in range(p - lo + 1):
                        if (e := machine.accepts(near, s)) >= 0 and e >= p - lo + m:
                            found[d]["spans"].setdefault(label, (lo + s - int(w.first[d]), e - s))
                            break
            rows = [(len(x["places"]), min(x["places"], default=None), max(x["places"], default=None), ",".join(sorted(x["base"])), ",".join(sorted(x["base"] | set(x["spans"]))), 1.0 if x["spans"] else 0.5 if x["base"] else 0.0, [{"label": k, "first": f, "words": n} for k, (f, n) in sorted(x["spans"].items())]) for x in found]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans_type]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(w.count, pa.int64()), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"])


def _starts(h: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Which positions hold the first of ``words`` and leave room for the others."""
    one = Words(np.frombuffer(words[0], np.uint8), np.array([0, len(words[0])]), ALNUM).hashes()[0]
    return h[: max(0, len(h) - len(words) + 1)] == one


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, templates.

    ``n_base``: places where the words of a phrase stand consecutively. A template's label is given where all of its
    wording outside optional and replaceable regions is there, word for word and in order; ``templates`` has its first
    such place. The score is 1 with a template, 0.5 with a phrase alone, else 0. Labels are sorted and comma-joined.
    Null and empty texts have no words: zeros, null places, empty labels. Repeated rows are scanned each; other
    columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("_id"), "text")
    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates array<struct<label: string, first: long, words: long>>"
    return slim.mapInArrow(lambda batches: _scan(batches, phrases, templates), schema).withColumnRenamed("_id", id_col)


def op7_template_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("templates")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH words AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') AS t FROM (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
placed AS (
  SELECT doc_id, w, t, list_sort(list_concat(
    [i - 1 FOR i IN range(1, len(w)) IF w[i] IN ('mit', 'apache') AND w[i + 1] = 'license'],
    [i - 1 FOR i IN range(1, len(w) - 1) IF w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'])) AS p,
    list_filter([{", ".join(f"CASE WHEN regexp_matches(t, ' {p}(?: |$)') THEN '{v}' END" for p, v in PHRASES.items())}], lambda x: x IS NOT NULL) AS base,
    list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{template_regex(m)}') THEN '{k}' END" for k, m in TEMPLATES.items())}], lambda x: x IS NOT NULL) AS found
  FROM words)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(p[1] AS BIGINT) AS first_word, CAST(p[-1] AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels,
       CASE WHEN len(found) > 0 THEN 1e0 WHEN len(base) > 0 THEN 5e-1 ELSE 0e0 END AS score
FROM placed
"""
