"""Licence scans by conditional compression, confirmed by exact wording differences."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .license_templates import TEMPLATES

# Fixed words, of which every template has some; a line with one is a candidate.
CUE = re.compile(r"licen[sc]e|copyright|permission|redistribut|warrant|public domain|creative commons|spdx|"
                 r"\bcc(?:0| by)|liab(?:le|ility)|unencumbered", re.I)
WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
NEAR_LINES = 2  # cue lines with no more lines than this between them are one block
LEVEL = 12  # the first with an optimal parser, which finds a notice in some hundred bytes; faster ones miss it
PAD = b" " * 8  # behind every text, as matches are not searched in the last bytes
LEAST_GAIN = 0.15  # of the template's own compressed size, below which a window does not resemble it
MOST_DIFFERENT = 0.15  # of the template's words may be missing or changed
NEARLY = 0.75  # of the bytes that the first confirmed template saves, from which another one is confirmed too
RUN, SHORT = 3, 12  # words in a row that make a place worth a look; one less in templates of up to so many words
REACH = 4  # times a template's words are in a window at least, and half of a window is in the next one


def blocks(text: str | None) -> list[tuple[int, int]]:
    """(first, last line number) of the blocks of a text, in order: neighbouring cue lines and what lies between."""
    found, at, last = [], None, 0
    for i, line in enumerate((text or "").split("\n")):
        if CUE.search(line):
            if at is not None and i - last > NEAR_LINES + 1:
                found.append((at, last))
                at = None
            at, last = (i if at is None else at), i
    if at is not None:
        found.append((at, last))
    return found


def padded(words: list[str]) -> bytes:
    return b" " + " ".join(words).encode() + b" " + PAD


def wording(block: list[str], template: list[str]) -> tuple[int, int, int, int, int]:
    """Words of the template that are missing, changed, and words put in between, and the place of the first word that
    matches and of the one behind the last; text around the match is free."""
    steps = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    missing = changed = added = 0
    inner = [s for i, s in enumerate(steps) if not (s[0] == "insert" and i in (0, len(steps) - 1))]
    for kind, a, b, c, d in inner:
        if kind == "delete":
            missing += b - a
        elif kind == "replace":
            edge = a == 0 or b == len(template)  # the surroundings may touch a changed end
            changed += b - a
            added += 0 if edge else max(0, (d - c) - (b - a))
        elif kind == "insert":
            added += d - c
    same = [s for s in steps if s[0] == "equal"]
    return missing, changed, added, same[0][3] if same else 0, same[-1][4] if same else 0


class Scanner:
    """Finds templates in texts.

    A text is cut into windows, each half in the next one, of a power of two words for each size of template, so that
    every match lies whole in a window. A window with a cue is compressed alone and with each template of its size as raw
    dictionary. Templates are ranked by the bytes they save; in that order the wording is compared, and the winner takes
    its words. What is left of the window is ranked anew, until nothing is confirmed.
    """

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        self.templates = [(name, WORD.findall(text.lower())) for name, text in templates]
        self.needs = [set(words) for _, words in self.templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.primed, self.own = [], []
        for _, words in self.templates:
            text = padded(words)
            table = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(level=LEVEL)
            self.primed.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_content_size=False,
                                                        write_checksum=False, write_dict_id=False))
            self.own.append(len(self.plain.compress(text)))
        self.sizes: dict[int, list[int]] = {}  # words of a window: templates
        self.runs: list[dict[tuple, list[int]]] = []  # words in a row: places in the template
        for i, (_, words) in enumerate(self.templates):
            self.runs.append({})
            long = RUN if len(words) > SHORT else RUN - 1
            for k in range(len(words) - long + 1):
                self.runs[i].setdefault(tuple(words[k:k + long]), []).append(k)
            self.sizes.setdefault(1 << (REACH * len(words) - 1).bit_length(), []).append(i)

    def saved(self, words: list[str], among: list[int]) -> list[int]:
        """Bytes that each template saves as a raw dictionary of these words."""
        data = padded(words)
        alone = len(self.plain.compress(data))
        return [alone - len(self.primed[i].compress(data)) for i in among]

    def confirm(self, words: list[str], i: int) -> tuple | None:
        """(missing, changed, added, start, end) of the place where fewest words of a template differ, if few enough do.

        Compared are the places that share most runs of words with the template, each with what lies within half of the
        template's length around it.
        """
        template, runs = self.templates[i][1], self.runs[i]
        n, best, tried = len(template), None, []
        if len(self.needs[i].difference(words)) > MOST_DIFFERENT * n:
            return None
        long = RUN if n > SHORT else RUN - 1
        votes = Counter(at - k for at in range(len(words) - long + 1) for k in runs.get(tuple(words[at:at + long]), ()))
        for shift, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            if any(abs(shift - other) <= n // 2 for other in tried):
                continue
            tried.append(shift)
            # The narrow window keeps equal words of the surroundings out, the wide one leaves room for words put in.
            for lo, hi in ((max(0, shift), shift + n), (max(0, shift - n), shift + 2 * n)):
                missing, changed, added, start, end = wording(words[lo:hi], template)
                if missing + changed <= MOST_DIFFERENT * n and added <= n:
                    one = (missing, changed, added, lo + start, lo + end)
                    best = one if best is None or sum(one[:3]) < sum(best[:3]) else best
        return best

    def winner(self, words: list[str], among: list[int]) -> tuple | None:
        """(bytes saved, template, match) of the template that wins the window.

        Templates are confirmed in the order of the bytes they save of the window. Those that save nearly as much as the
        first confirmed one (variants of one notice) are confirmed too; of them that which saves most of its own match
        wins, then that with fewer differences.
        """
        best, top = None, None
        for less, i in sorted(zip((-s for s in self.saved(words, among)), among)):
            if -less < LEAST_GAIN * self.own[i]:
                continue
            if top is not None and -less < NEARLY * top:
                break
            one = self.confirm(words, i)
            if one:
                top = -less if top is None else top
                [more] = self.saved(words[one[3]:one[4]], [i])
                best = min(filter(None, (best, (-more, sum(one[:3]), i, one))))
        return best and (-best[0], *best[2:])

    def find(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(licence, gain, missing, changed, added) of every confirmed template of a text whose words do not overlap those
        of one that saves more bytes of its own match; gain is that saving as a share of the template's compressed size."""
        words = WORD.findall(text.lower())
        cues = cue_places(words)
        found = []
        for size, among in self.sizes.items():
            half, spans = size // 2, []
            for at in sorted({max(0, cue // half - k) for cue in cues for k in (0, 1)}):
                todo = [(at * half, min(len(words), at * half + size))]
                while todo:
                    start, end = todo.pop()
                    cut = next(((a, b) for a, b in reversed(spans[-size:]) if a < end and b > start), None)
                    if cut:  # words of an earlier match are left out
                        todo += [(start, cut[0]), (cut[1], end)]
                    elif start < end and bisect_right(cues, end - 1) > bisect_right(cues, start - 1):
                        best = self.winner(words[start:end], among)
                        if best:
                            more, i, (*different, first, last) = best
                            span = (start + first, start + last)
                            if any(different) and (first == 0 or span[1] == end):  # the window may cut the match
                                lo = max([b for _, b in spans if b <= span[0]], default=0)
                                hi = min([a for a, _ in spans if a >= span[1]], default=len(words))
                                lo, hi = max(lo, span[0] - size), min(hi, span[1] + size)
                                *different, first, last = self.confirm(words[lo:hi], i) or (*different, span[0] - lo, span[1] - lo)
                                span = (lo + first, lo + last)
                                [more] = self.saved(words[span[0]:span[1]], [i])
                            spans.append(span)
                            found.append((-more, span, i, different))
                            todo += [(start, span[0]), (span[1], end)]
        out, taken = [], bytearray(len(words))
        for less, (start, end), i, different in sorted(found):
            if not any(taken[start:end]):
                taken[start:end] = b"\x01" * (end - start)
                out.append((self.templates[i][0], -less / self.own[i], *different))
        return out


def cue_places(words: list[str]) -> list[int]:
    """Numbers of the words at which a cue begins."""
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    return sorted({bisect_right(starts, m.start()) - 1 for m in CUE.finditer(" ".join(words))})


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_blocks, n_licenses, licenses (names, sorted, joined by commas; null if none), gain,
    n_missing, n_changed, n_added (of the match with the largest gain).

    Each document is read whole and judged alone, in its own row, so nothing is shuffled. A text with a cue is searched
    window by window, whatever its lines; gain is the share of the template's own compressed size. Null and empty texts
    have no blocks. Repeated rows give repeated rows.
    """
    schema = ("doc_id long, n_blocks long, n_licenses long, licenses string, gain double, n_missing long, n_changed long, "
              "n_added long")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = blocks(text)
                hits = scanner.find(text) if found else []
                top = max(hits, key=lambda f: (f[1], f[0])) if hits else (None,) * 5
                licences = sorted({f[0] for f in hits})
                rows.append((len(found), len(licences), ",".join(licences) or None, *top[1:]))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
