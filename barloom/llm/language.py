"""Languages of documents and of their prose blocks.

Word first, with backoff: a known word is scored by its log frequency in each language; an unknown one by
its longest character n-grams that some language has, shorter and shorter ones where none is known. The
model is fitted on the prose of a bounded sample of labelled documents (``SAMPLE``); labels may be wrong,
so it is fitted twice, the second time on blocks as the first model reads them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.materialize import written
from barloom.sources.tables import require_columns

#: Labelled documents the model is fitted on, at most; words and n-grams kept per language, at most.
SAMPLE, WORDS, GRAMS = 6_000, 20_000, 20_000
#: Documents of a language in the sample, about, where the table has so many: no labelled language is unknown to the model.
LEAST = 50
LONGEST_GRAM, UNSEEN_KEPT = 5, 200_000
LABELLED = "doc_id long, block_no long, lang_code string, confidence double, words long"

# The two-letter codes of ISO 639-1 ("na", which labels use for "not available", left out), and longer codes and
# names of the languages most often met. Languages beyond these names are read by their two-letter codes.
ISO_639_1 = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my "
    "nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty "
    "ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
_NAMES = {
    "ar": "ara arabic", "cs": "ces cze czech", "da": "dan danish", "de": "deu ger german deutsch", "el": "ell gre greek", "en": "eng english", "es": "spa spanish espanol español",
    "fi": "fin finnish", "fr": "fra fre french francais français", "hi": "hin hindi", "hu": "hun hungarian", "it": "ita italian italiano", "ja": "jpn japanese", "ko": "kor korean",
    "nl": "nld dut dutch nederlands", "no": "nor norwegian", "pl": "pol polish", "pt": "por portuguese portugues português", "ro": "ron rum romanian",
    "ru": "rus russian русский", "sv": "swe swedish", "tr": "tur turkish", "uk": "ukr ukrainian", "vi": "vie vietnamese", "zh": "zho chi chinese",
}
CODES = {c: c for c in ISO_639_1} | {name: code for code, names in _NAMES.items() for name in names.split()}

# Commands whose arguments are no prose, and environments that hold none.
_SILENT = (
    "section subsection subsubsection paragraph subparagraph chapter part title author date caption label ref eqref cite citep citet input include "
    "includegraphics usepackage documentclass bibliography bibliographystyle pagestyle newcommand renewcommand providecommand DeclareMathOperator "
    "def let begin end newtheorem url href thanks affiliation email keywords vspace hspace"
).split()
_NO_PROSE = "equation align gather multline eqnarray displaymath math figure table tabular thebibliography verbatim lstlisting tikzpicture array"

_BLANK = re.compile(r"\n(?:[ \t\r]*\n)+")
_COMMENT = re.compile(r"^[ \t]*%.*$|(?<!\\)%.*$", re.M)
_ENV = re.compile(r"\\begin\{(" + "|".join(_NO_PROSE.split()) + r")\*?\}.*?(?:\\end\{\1\*?\}|\Z)", re.S)
_OPENED = re.compile(r"\\begin\{thebibliography\}")
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_ARG = r"(?:\[[^\]]*\]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\\[A-Za-z]+)"
_SILENCED = re.compile(r"\\(?:" + "|".join(_SILENT) + r")(?![A-Za-z])\*?(?:[ \t]*" + _ARG + r")*")
_BIBITEM = re.compile(r"\\bibitem.*", re.S)
_ANY_COMMAND = re.compile(r"\\[A-Za-z@]+\*?|\\.")
_WORD = re.compile(r"[^\W\d_]+")


def language_code(label: Column) -> Column:
    """ISO 639-1 code of a label (a code of two letters, a longer one of _NAMES, with or without a region, or a name, in
    any case); NULL for a missing one, a placeholder or anything else. Which languages the model knows is fitted from
    these labels, not fixed here."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_-]+)", 1)
    pairs = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.element_at(pairs, F.when(F.length(head) > 0, head))


def prose_blocks(text: str | None) -> list[tuple[int, list[str]]]:
    """(block number, words in lower case) of the blocks that hold prose. Blocks lie between blank lines,
    counted from 0. Headings, titles, formulas, captions, bibliography and commented lines hold none."""
    out, in_bibliography = [], False
    for no, block in enumerate(_BLANK.split(text or "")):
        if "%" in block:
            block = _COMMENT.sub("", block)
        if in_bibliography:
            head, end, block = block.partition("\\end{thebibliography}")
            in_bibliography = not end
        if "\\" in block:
            if (m := None if "thebib" not in block else _OPENED.search(block)) and "\\end{thebibliography}" not in block[m.end():]:
                in_bibliography, block = True, block[:m.start()]
            block = _ENV.sub(" ", block)
            block = _SILENCED.sub(" ", block)
            block = _BIBITEM.sub(" ", block)
        if "$" in block or "\\" in block:
            block = _MATH.sub(" ", block)
        if "\\" in block:
            block = _ANY_COMMAND.sub(" ", block.replace("\\-", ""))
        words = _WORD.findall(block.lower())
        if words:
            out.append((no, words))
    return out


@dataclass
class LanguageModel:
    """Log frequencies of words and of character n-grams per language."""

    codes: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    unseen: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.zero = np.zeros(len(self.codes))
        self.table = np.array(list(self.words.values())) if self.words else np.zeros((0, len(self.codes)))
        self.number = {w: i for i, w in enumerate(self.words)}

    def unknown(self, word: str) -> np.ndarray:
        """Score of a word no language has: the mean of its longest known n-grams."""
        if (v := self.unseen.get(word)) is not None:
            return v
        padded, v = f"^{word}$", self.zero
        for n in range(min(LONGEST_GRAM, len(padded)), 0, -1):
            hits = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i:i + n])) is not None]
            if hits:
                v = np.mean(hits, axis=0)
                break
        if len(self.unseen) < UNSEEN_KEPT and len(word) <= 64:  # a cache, not a limit: others are scored again
            self.unseen[word] = v
        return v

    def score(self, words: list[str]) -> np.ndarray:
        """Sum of the words' scores per language."""
        get = self.number.get
        ids = [get(w, -1) for w in words]
        known = np.array(ids)
        total = self.table[known[known >= 0]].sum(axis=0) if len(self.table) else self.zero.copy()
        for w, i in zip(words, ids):
            if i < 0:
                total = total + self.unknown(w)
        return total

    def judge(self, words: list[str]) -> tuple[int, float]:
        """(number of the best language, confidence): the posterior under even priors, of evidence as the
        mean word gives it, counted for at most 20 words, as words of one text are not independent."""
        s = self.score(words)
        s = s * (min(len(words), 20) / max(1, len(words)))
        p = np.exp(s - s.max())
        best = int(s.argmax())
        return best, float(p[best] / p.sum())


def _counted(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Documents per language and word over the sample's prose: by label, or as a model reads each block. A
    document counts once, so a long one with a wrong label weighs no more than a short one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for code, text in zip(b["code"], b["text"]):
                seen: set = set()
                blocks = [words for _, words in prose_blocks(text)]
                read = [code] * len(blocks)
                if model:
                    read, weight = [model.judge(words)[0] for words in blocks], np.zeros(len(model.codes))
                    for k, words in zip(read, blocks):
                        weight[k] += len(words)
                    # A few words alone tell little: they count under the document's main language.
                    read = [model.codes[int(weight.argmax()) if len(words) < 5 else k] for k, words in zip(read, blocks)]
                for c, words in zip(read, blocks):
                    seen.update((c, w) for w in words)
                counts.update(seen)
        yield pd.DataFrame([(c, w, n) for (c, w), n in counts.items()], columns=["code", "word", "n"])

    return documents.mapInPandas(run, "code string, word string, n long").groupBy("code", "word").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame) -> LanguageModel | None:
    w = Window.partitionBy("code").orderBy(F.col("n").desc(), F.col("word"))
    rows = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= WORDS).select("code", "word", "n").collect()
    codes = sorted({r["code"] for r in rows})
    if not codes:
        return None
    at = {c: i for i, c in enumerate(codes)}
    words: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    for r in rows:
        k, word, n = at[r["code"]], r["word"], r["n"]
        words.setdefault(word, np.zeros(len(codes)))[k] += n
        padded = f"^{word}$"
        for m in range(1, LONGEST_GRAM + 1):
            for i in range(len(padded) - m + 1):
                grams.setdefault(padded[i:i + m], np.zeros(len(codes)))[k] += n
    total_w = sum(words.values())
    by_length: dict[int, np.ndarray] = {}
    for g, v in grams.items():
        by_length[len(g)] = by_length.get(len(g), 0) + v
    # A word never seen in a language counts as half a time, whatever the language's share of the sample.
    scale = total_w.max() / np.maximum(total_w, 1)
    log = lambda v, total, s: np.log((v + 0.5 / s) / (total + 1))
    kept: dict[str, np.ndarray] = {}
    for k in range(len(codes)):
        best = sorted((g for g in grams if grams[g][k]), key=lambda g: (-grams[g][k], g))[:GRAMS]
        kept |= {g: grams[g] for g in best}
    return LanguageModel(
        codes, {w: log(v, total_w, scale) for w, v in words.items()}, {g: log(v, by_length[len(g)], scale) for g, v in kept.items()})


def fit_languages(documents: DataFrame, sample: int = SAMPLE, rounds: int = 2) -> LanguageModel | None:
    """The model of the labelled documents, about ``sample`` of them at most and LEAST more per language, drawn by
    hash of doc_id from those of the whole table. All of a table with no more are taken. Two passes, one to count.
    None if no document has a readable label."""
    labelled = documents.select("doc_id", "text", language_code(F.col("lang")).alias("code")).where(
        F.col("code").isNotNull() & F.col("text").isNotNull())
    count = {r["code"]: r["count"] for r in labelled.groupBy("code").count().collect()}
    n = sum(count.values())
    if n > sample:
        share = F.create_map(*[F.lit(x) for c, k in count.items() for x in (c, math.ceil(max(sample / n, min(1, LEAST / k)) * 1_000_000_000))])
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000_000)) < F.element_at(share, F.col("code")))
    labelled = written(labelled.select("code", "text"), "sample")
    model = _model(_counted(labelled, None))
    for _ in range(rounds - 1):
        if model:
            model = _model(_counted(labelled, model)) or model
    return model


def label_languages(documents: DataFrame, model: LanguageModel | None = None, all_blocks: bool = False, said: Column | None = None) -> DataFrame:
    """LABELLED and ``said``, the language code that a column expression over ``documents`` gives (by default
    language_code() of ``lang``), so that labels can be compared without a join: per document one row with block_no -1, its main language (that of most prose words), the
    confidence, which is the share of its words in that language times their mean confidence, and its prose
    words; and one row per prose block in another language (``all_blocks``: per prose block).

    A document without prose is judged by all its words; one without any word, or all documents where there
    is no model, gets a null language with confidence 0. Whole texts are read. Repeated documents give
    repeated rows, an empty table none; other columns are ignored.
    """
    require_columns(documents, {"doc_id", "text", "lang"})
    model = model or fit_languages(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    said = language_code(F.col("lang")) if said is None else said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, names = shared.value, ["doc_id", "block_no", "lang_code", "confidence", "words", "said"]
        for b in batches:
            out: list[tuple] = []
            for doc, text, tag in zip(b["doc_id"], b["text"], b["said"]):
                blocks = prose_blocks(text)
                if m is None:
                    out.append((doc, -1, None, 0.0, sum(len(w) for _, w in blocks), tag))
                    continue
                judged = [(no, len(w), *m.judge(w)) for no, w in blocks]
                total = sum(n for _, n, _, _ in judged)
                if not judged:
                    words = _WORD.findall(_ANY_COMMAND.sub(" ", text or "").lower())
                    k, p = m.judge(words) if words else (None, 0.0)
                    out.append((doc, -1, None if k is None else m.codes[k], p, 0, tag))
                    continue
                weight, sure = np.zeros(len(m.codes)), np.zeros(len(m.codes))
                for _, n, k, p in judged:
                    weight[k] += n
                    sure[k] += n * p
                main = int(weight.argmax())
                out.append((doc, -1, m.codes[main], float(sure[main] / total), total, tag))
                out += [(doc, no, m.codes[k], p, n, tag) for no, n, k, p in judged if all_blocks or k != main]
            yield pd.DataFrame(out, columns=names)

    return documents.select("doc_id", "text", said.alias("said")).mapInPandas(run, f"{LABELLED}, said string")
