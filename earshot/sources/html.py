"""Speaker turns from web pages with a transcript."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = ("p", "h2", "h3", "h4")
#: Fixed formats of transcript pages: a direction for the stage, and how the host is marked.
DIRECTION = r"[<\[][^>\]]*[>\]]"
HOST_MARK = r"(?i)\s*\(host\)$"


class _Blocks(HTMLParser):
    """The paragraphs and headings of a page as (text, bold text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.open: list[list[str]] | None = None
        self.bold = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close()
            self.open = [[], []]
        elif tag == "strong":
            self.bold += 1
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._close()
        elif tag == "strong":
            self.bold = max(0, self.bold - 1)

    def handle_data(self, data):
        if self.open is not None:
            self.open[0].append(data)
            if self.bold:
                self.open[1].append(data)

    def _close(self):
        if self.open is not None:
            text, bold = (" ".join(" ".join(x).replace("\xa0", " ").split()) for x in self.open)
            if text:
                self.blocks.append((text, bold))
        self.open, self.bold = None, 0


def page_turns(html: str | None) -> list[tuple[str, str]]:
    """(speaker, text) in order, neighbours of one speaker merged; empty if the page has no transcript.

    After the bold word 'Transcript', a short bold line that ends no sentence names a speaker; what follows is theirs.
    Stage directions in brackets are dropped, and so is a speaker in them.
    """
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._close()
    blocks = parser.blocks
    begin = next((i for i, (_, bold) in enumerate(blocks) if bold.lower() == "transcript"), None)
    if begin is None:
        return []
    turns: list[list] = []
    for text, bold in blocks[begin + 1 :]:
        if bold and bold == text and len(text.split()) <= 6 and text[-1] not in ".?!":
            turns.append([re.sub(HOST_MARK, "", text.rstrip(":")), []])
        elif turns and not re.fullmatch(DIRECTION, text):
            turns[-1][1].append(text)
    out: list[list[str]] = []
    for who, said in turns:
        if said and not who.startswith("<"):
            if out and out[-1][0] == who:
                out[-1][1] += " " + " ".join(said)
            else:
                out.append([who, " ".join(said)])
    return [tuple(x) for x in out]


def html_turns(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, turn, speaker, text) of every page."""

    def run(batches):
        for pdf in batches:
            rows = [(k, i, *t) for k, h in zip(pdf["k"], pdf["h"]) for i, t in enumerate(page_turns(h))]
            yield pd.DataFrame(rows, columns=["k", "turn", "speaker", "text"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.selectExpr(f"`{key}` AS k", f"`{html}` AS h")
    return rows.mapInPandas(run, f"k {kind}, turn int, speaker string, text string").withColumnRenamed("k", key)
