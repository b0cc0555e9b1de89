"""Problem 10: the languages of documents, as mixtures of n-gram models."""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.mail import text_bodies
from tallyloom.plans.shared import spread, write_table

#: Codes and names of languages as labels write them.
CODES = {
    "cs": ("cs", "ces", "cze", "czech", "čeština"),
    "da": ("da", "dan", "danish", "dansk"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "it": ("it", "ita", "italian", "italiano"),
    "fi": ("fi", "fin", "finnish", "suomi"),
    "hu": ("hu", "hun", "hungarian", "magyar"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "no": ("no", "nor", "nb", "nob", "norwegian", "norsk"),
    "pl": ("pl", "pol", "polish", "polski"),
    "pt": ("pt", "por", "portuguese", "português"),
    "ro": ("ro", "ron", "rum", "romanian", "română"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "tr": ("tr", "tur", "turkish", "türkçe"),
}
CODE_OF = {code: lang for lang, codes in CODES.items() for code in codes}
#: Labelled documents that the models are fitted on, about; the choice is by hash of the id.
SAMPLE_DOCS = 6000
#: Buckets that hashed words and hashed letter triples fall into.
WORDS, TRIPLES = 1 << 18, 1 << 15
#: Pseudo-counts of the background in each model.
PRIOR = 5.0
#: What another language must add to a document's log likelihood.
PENALTY = 8.0
#: A sentence counts as a part in its language with so many words and so much confidence.
PART_WORDS, PART_CONFIDENCE = 8, 0.9
#: Characters of text that are worked on at a time within a task; a longer document stands alone.
CHUNK_CHARS = 2_000_000
MOST_CACHED = 400_000
#: A language is told apart if so many of the labelled documents bear it.
LEAST_LABELLED = 0.002
#: Proportions are fitted until none moves by so much, in this many rounds at most.
TOLERANCE, MOST_ROUNDS = 1e-3, 500
_TOKEN = re.compile(r"[^\W_]+")
_QUOTE = re.compile(r"[>\s|]*")
_END = re.compile(r"(?<=[.!?])[\"'»”)\]]*\s+")
_RULE = re.compile(r"[-_*=]{3,}")
_FIELD = re.compile(r"[^\W\d_][\w -]{0,24}:\s")


def sentences(bodies: list[str]) -> list[list[str]]:
    """The words (runs of letters and digits, lower case) of each sentence of the bodies.

    Lines of a paragraph belong together; a change of quotation, a blank line, a rule or a line that ends in a colon
    ends a paragraph. The header fields of a forwarded message, which follow a rule, are no sentences.
    """
    found: list[list[str]] = []

    def close(lines: list[str]) -> None:
        if lines:
            for piece in _END.split(" ".join(lines)):
                if words := _TOKEN.findall(piece.lower()):
                    found.append(words)
            lines.clear()

    for body in bodies:
        lines: list[str] = []
        depth, after_rule = 0, False
        for line in body.splitlines():
            lead = _QUOTE.match(line).end()
            text, at = line[lead:].rstrip(), line.count(">", 0, lead)
            if not text or at != depth:
                close(lines)
                depth = at
                after_rule = after_rule and bool(text)
            if not text:
                continue
            if _RULE.match(text):
                close(lines)
                after_rule = True
            elif after_rule and _FIELD.match(text):
                continue
            else:
                after_rule = False
                lines.append(text)
                if text[-1] == ":":
                    close(lines)
        close(lines)
    return found


def _hash(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % buckets


def features(word: str) -> tuple[int, list[int]]:
    padded = f"<{word}>"
    return _hash(word, WORDS), [_hash(padded[i : i + 3], TRIPLES) for i in range(len(padded) - 2)]


class Models:
    """Log likelihoods of words under each language, relative to the background of all languages."""

    def __init__(self, words: np.ndarray, triples: np.ndarray, languages: list[str]):
        self.tables, self.languages = [self._table(words), self._table(triples)], languages
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.languages)), "float32")

    @staticmethod
    def _table(counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(0), 1)
        share = counts / total
        background = share.mean(1) + 1e-9
        return np.log((counts + PRIOR * background[:, None] * 1000) / (total + PRIOR * 1000) / background[:, None]).astype("float32")

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "languages": self.languages}

    def __setstate__(self, state: dict) -> None:
        self.tables, self.languages = state["tables"], state["languages"]
        self._forget()

    def of_words(self, words: list[str]) -> np.ndarray:
        """Row numbers in scores; the words' scores are computed once and kept."""
        rows, out = self.rows, []
        for w in words:
            i = rows.get(w)
            if i is None:
                i = rows[w] = len(rows)
                if i >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                if w[0].isalpha():
                    word, triples = features(w)
                    self.scores[i] = 0.5 * (self.tables[0][word] + self.tables[1][triples].mean(0) * min(3, len(triples)))
            out.append(i)
        return np.array(out, "int64")

    def likelihoods(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all sentences of docs in a row: log likelihoods, document number, words."""
        if len(self.rows) > MOST_CACHED:
            self._forget()
        flat = [s for d in docs for s in d]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        n = np.array([len(s) for s in flat], "int64")
        if not len(n):
            return np.zeros((0, len(self.languages))), owner, n
        rows = self.of_words([w for s in flat for w in s])
        return np.add.reduceat(self.scores[rows], np.concatenate([[0], np.cumsum(n)[:-1]])).astype("float64"), owner, n


def mixture(like: np.ndarray, owner: np.ndarray, n: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of each document's languages, posteriors of each sentence's) by expectation-maximisation.

    Each round takes sentences' posteriors under their document's proportions, then proportions from the posteriors by
    words, until no proportion moves. Languages whose removal costs a document less than PENALTY are then dropped, the
    least useful first, until each that is left earns its place, and the proportions are fitted anew.
    """
    k = like.shape[1]
    allowed = np.ones((docs, k), bool)
    top = like.max(1, keepdims=True) if len(like) else np.zeros((0, 1))
    weight = np.exp(like - top)
    share, post = np.zeros((docs, k)), np.zeros_like(weight)

    def fit(chosen: np.ndarray) -> None:
        """share and post of the chosen documents anew; each leaves the rounds once its own proportions rest."""
        share[chosen] = allowed[chosen] / allowed[chosen].sum(1, keepdims=True)
        rows = np.flatnonzero(chosen[owner])
        ids = np.flatnonzero(chosen)
        place = (np.cumsum(chosen) - 1)[owner[rows]]
        for _ in range(MOST_ROUNDS):
            p = share[ids][place] * weight[rows]
            p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
            post[rows] = p
            now = np.stack([np.bincount(place, p[:, j] * n[rows], len(ids)) for j in range(k)], 1) + 1e-3 * allowed[ids]
            now /= now.sum(1, keepdims=True)
            going = np.abs(now - share[ids]).max(1, initial=0.0) >= TOLERANCE
            share[ids] = now
            kept = going[place]
            rows, place, ids = rows[kept], (np.cumsum(going) - 1)[place[kept]], ids[going]
            if not len(ids):
                return
        warnings.warn(f"proportions of {len(ids)} documents still move after {MOST_ROUNDS} rounds", stacklevel=2)

    fit(np.ones(docs, bool))
    for _ in range(k - 1):
        each = share[owner] * weight
        whole = np.maximum(each.sum(1), 1e-300)
        gain = np.full((docs, k), np.inf)
        for j in range(k):
            rest = np.maximum(whole - each[:, j], 1e-300) / np.maximum(1 - share[owner, j], 1e-9)
            gain[:, j] = np.where(allowed[:, j], np.bincount(owner, np.log(whole) - np.log(rest), docs), np.inf)
        worst = gain.argmin(1)
        drop = (gain[np.arange(docs), worst] < PENALTY) & (allowed.sum(1) > 1)
        if not drop.any():
            break
        allowed[np.flatnonzero(drop), worst[drop]] = False
        fit(drop)
    return share, post


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list, list[list[list[str]]]]]:
    """(ids, labels, sentences) of about CHUNK_CHARS of text at a time."""
    ids, labels, docs, size = [], [], [], 0
    for frame in frames:
        for doc_id, label, text in zip(frame["id"], frame["lang"], frame["text"], strict=True):
            ids.append(doc_id)
            labels.append(label)
            docs.append(sentences(text_bodies(text)))
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield ids, labels, docs
                ids, labels, docs, size = [], [], [], 0
    if ids:
        yield ids, labels, docs


def _counted(docs: list[list[list[str]]], langs: np.ndarray) -> pd.DataFrame:
    """Hashed counts (kind, bucket, lang, n); langs has the language of each sentence in a row, -1 for none."""
    counts: dict[tuple[int, int, int], int] = {}
    known: dict[str, tuple[int, list[int]]] = {}
    for sentence, lang in zip((s for d in docs for s in d), langs.tolist(), strict=True):
        if lang < 0:
            continue
        for w in sentence:
            if not w[0].isalpha():
                continue
            word, triples = known.get(w) or known.setdefault(w, features(w))
            counts[0, word, lang] = counts.get((0, word, lang), 0) + 1
            for t in triples:
                counts[1, t, lang] = counts.get((1, t, lang), 0) + 1
    return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "bucket", "lang", "n"])


def _models(counted: DataFrame, languages: list[str]) -> Models:
    tables = [np.zeros((WORDS, len(languages))), np.zeros((TRIPLES, len(languages)))]
    for r in counted.groupBy("kind", "bucket", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
        tables[r["kind"]][r["bucket"], r["lang"]] = r["n"]
    return Models(*tables, languages)


def code_of(label: str | None) -> str | None:
    """The two-letter code that a label stands for, in any code style; None for missing and unknown ones."""
    return CODE_OF.get(re.split(r"[-_. ]", (label or "").strip().lower())[0])


def fit_models(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models fitted on about sample_docs labelled documents of docs (id, lang, text), chosen by hash of the id.

    The languages are those that LEAST_LABELLED of the labelled documents bear. Labels are taken as they are at first; then each sentence of the sample is assigned its language by the first
    models, and the second models are counted from those, which clears wrong labels and mixed documents. What comes
    to the driver is bounded by the number of hash buckets.
    """
    code = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])[F.lower(F.split(F.trim("lang"), "[-_. ]")[0])]
    labelled = docs.withColumn("code", code).where(F.col("code").isNotNull() & F.col("text").isNotNull())
    borne = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(borne.values())
    languages = sorted(c for c, n in borne.items() if n >= LEAST_LABELLED * total) or ["en"]
    step = max(1, total // sample_docs)
    sample = write_table(labelled.where(F.col("code").isin(languages)).drop("code").where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0), "language-sample")
    shape = "kind int, bucket int, lang int, n bigint"

    def count(first: Models | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, labels, found in _chunks(frames):
                if first is None:
                    langs = np.repeat([languages.index(code_of(x)) for x in labels], [len(d) for d in found])
                else:
                    like, owner, n = first.likelihoods(found)
                    _, post = mixture(like, owner, n, len(found))
                    langs = np.where((post.max(1) > PART_CONFIDENCE) & (n >= 4), post.argmax(1), -1) if len(n) else np.zeros(0, "int64")
                yield _counted(found, langs.astype("int64"))

        return _models(sample.mapInPandas(run, shape), languages)

    return count(count(None))


def document_languages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """id, kind, lang, confidence, words, label_lang: the main language of each document and its parts in others.

    kind 'main': the language with most words in the decoded text bodies, the first by code if equal; one row for each
    document, with null lang and confidence 0 where no word occurs (empty and null texts). kind 'part': each other
    language in which a sentence has PART_WORDS words or more, confidence the highest of such a sentence. words are
    those of the language's sentences. label_lang is what the document's label stands for, null if missing
    or unknown. The languages are those of the labels. Repeated documents come out each time; other columns don't
    matter. Without any labelled document there is one language, en.

    Two passes: one over a bounded sample to fit the models, one over all documents, which never move.
    """
    docs = spread(documents.select(F.col(id_col).alias("id"), F.col(label_col).alias("lang"), F.col(text_col).alias("text")))
    held = documents.sparkSession.sparkContext.broadcast(fit_models(docs, sample_docs))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, k = held.value, len(held.value.languages)
        for ids, labels, found in _chunks(frames):
            like, owner, n = models.likelihoods(found)
            _, post = mixture(like, owner, n, len(found))
            best = post.argmax(1) if len(n) else np.zeros(0, "int64")
            sure = post.max(1) if len(n) else np.zeros(0)
            cell = owner * k + best
            words = np.bincount(cell, n, len(found) * k).reshape(-1, k)
            trust = np.bincount(cell, n * sure, len(found) * k).reshape(-1, k)
            clear = np.zeros(len(found) * k)
            whole = (n >= PART_WORDS) & (sure >= PART_CONFIDENCE)
            np.maximum.at(clear, cell[whole], sure[whole])
            clear = clear.reshape(-1, k)
            main = words.argmax(1)
            rows = []
            for d, (doc_id, label) in enumerate(zip(ids, labels, strict=True)):
                told, m = code_of(label), int(main[d])
                if not words[d, m]:
                    rows.append((doc_id, "main", None, 0.0, 0, told))
                    continue
                rows.append((doc_id, "main", models.languages[m], trust[d, m] / words[d, m], int(words[d, m]), told))
                rows.extend((doc_id, "part", models.languages[j], clear[d, j], int(words[d, j]), told) for j in range(k) if j != m and clear[d, j] > 0)
            yield pd.DataFrame(rows, columns=["id", "kind", "lang", "confidence", "words", "label_lang"])

    return docs.mapInPandas(run, f"id {id_type}, kind string, lang string, confidence double, words int, label_lang string").withColumnRenamed("id", id_col)


def language_findings(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, lang, kind: mains whose label is missing or another, and all parts."""
    wrong = (F.col("kind") == "main") & F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label_lang"))
    return found.where(wrong | (F.col("kind") == "part")).select(id_col, "lang", "kind")
