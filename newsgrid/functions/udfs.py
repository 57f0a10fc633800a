"""Optional Python extensions; every job has a native form without them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from newsgrid.functions.html import opening_pattern


class _Body(HTMLParser):
    """Text inside the first element whose start tag matches a pattern."""

    _VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
             "track", "wbr"}

    def __init__(self, opening: re.Pattern) -> None:
        super().__init__(convert_charrefs=True)
        self.opening, self.tag, self.depth, self.done = opening, "", 0, False
        self.mute, self.parts = "", []

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if self.depth == 0:
            if self.opening.match(self.get_starttag_text()):
                self.tag, self.depth = tag, 1
            return
        if tag in ("script", "style"):
            self.mute = tag
        if tag == self.tag and tag not in self._VOID:
            self.depth += 1
        self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.done or self.depth == 0:
            return
        if tag == self.mute:
            self.mute = ""
        if tag == self.tag:
            self.depth -= 1
            self.done = self.depth == 0
        self.parts.append(" ")

    def handle_data(self, data):
        if self.depth and not self.done and not self.mute:
            self.parts.append(data)


def page_body_udf(containers: Sequence[str]):
    """Arrow-batched page body by an HTML parser, for markup expressions cannot follow."""
    # Java and Python read these patterns alike.
    patterns = [re.compile(opening_pattern(s)[0]) for s in containers]

    def body(html: str | None) -> str:
        for pattern in patterns:
            if html and pattern.search(html):
                parser = _Body(pattern)
                parser.feed(html)
                if parser.tag:
                    return re.sub(r"\s+", " ", "".join(parser.parts)).strip()
        return ""

    @F.pandas_udf("string")
    def bodies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(body)

    return bodies


def candidate_udtf(stop_words: Sequence[str]):
    """``place_candidates(title)`` as a table function: ``pos, candidate``."""
    stops = frozenset(stop_words)

    class PlaceCandidates:
        def eval(self, title: str):
            multi = re.findall(
                r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:,\s*[A-Z][a-z]+)*\b", title or "")
            single = [w for w in re.findall(r"\b[A-Z][a-z]{3,}\b", title or "") if w not in stops]
            first: dict[str, str] = {}
            for span in [m.strip(" ,.-") for m in multi] + single:
                first.setdefault(span.lower(), span)
            yield from enumerate(v for k, v in first.items() if k)

    return F.udtf(PlaceCandidates, returnType="pos int, candidate string")
