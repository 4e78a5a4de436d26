"""Operator 9: subword lattice likelihood.

The vocabulary of an existing tokenizer is a unigram model whose piece scores
are estimated from the training documents: their words are segmented by the
tokenizer, piece counts are summed over the corpus and smoothed by one.  The
probability of a word is the sum over all its segmentations into pieces, by a
forward recursion in log space; words do not share pieces, so a text's log
probability is the sum over its words and its end.  Every distinct word of the
corpus is counted and scored once (see word_blocks).

The recursion runs over the UTF-8 bytes of the word behind the vocabulary's word
mark.  Byte pieces belong to the vocabulary and so take part in all
segmentations; they make every text reachable.

Results for odd input: null or empty text has its end token only; a null doc_id
is a training row; rows that repeat a doc_id are scored and counted each; with
no training rows every count is 0; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_blocks as W
from .kernels import _BYTE, LOWER, SPACES, U64, _powers, mix, span_hashes, word_spans
from .store import Stage, partitions

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
_MODELS: dict = {}


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def lower_words(data, offsets):
    """Words of the contract: A-Z lower-cased, cut at ASCII white space."""
    data = LOWER[data]
    return (data, *word_spans(data, offsets, ~SPACES))


class Lattice:
    """Pieces of a vocabulary with natural log probabilities, found by the hash of their bytes."""

    def __init__(self, path: str, logp: np.ndarray):
        m = _model(path)
        texts, ids, self.byte = [], [], np.full(256, -np.inf)
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                self.byte[int(m.id_to_piece(i)[3:5], 16)] = logp[i]
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                texts.append(m.id_to_piece(i).encode())
                ids.append(i)
        sizes = np.asarray([len(t) for t in texts])
        ends = np.cumsum(sizes)
        h = span_hashes(np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends)
        order = np.argsort(h)
        self.hashes, self.logp, self.lengths = h[order], logp[np.asarray(ids)][order], sorted(set(sizes.tolist()))
        self.by_text = dict(zip(texts, logp[np.asarray(ids)].tolist()))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(h & U64((1 << 20) - 1)).astype(np.int64)] = True

    def _same_length(self, words: np.ndarray) -> np.ndarray:
        """Log probabilities of words given as rows of bytes."""
        n, size = words.shape
        up, down = _powers(size + 1)
        total = np.zeros((n, size + 1), U64)
        np.cumsum(_BYTE[words] * up[:size], axis=1, out=total[:, 1:])
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            alpha[j] = alpha[j - 1] + self.byte[words[:, j - 1]]
            for k in self.lengths:
                if k > j:
                    break
                h = mix((total[:, j] - total[:, j - k]) * down[j - k])
                hit = np.flatnonzero(self.filter[(h & U64((1 << 20) - 1)).astype(np.int64)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                same = self.hashes[at] == h[hit]
                hit, at = hit[same], at[same]
                alpha[j, hit] = np.logaddexp(alpha[j, hit], alpha[j - k, hit] + self.logp[at])
        return alpha[size]

    def _one(self, word: bytes) -> float:
        """The same recursion for one long word, with a window of the longest piece."""
        alpha = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            terms = [alpha[j - 1] + float(self.byte[word[j - 1]])]
            for k in self.lengths:
                if k > j:
                    break
                p = self.by_text.get(word[j - k:j])
                if p is not None:
                    terms.append(alpha[j - k] + p)
            top = max(terms)
            alpha[j] = top + float(np.log(sum(np.exp(t - top) for t in terms))) if top > -np.inf else -np.inf
        return alpha[-1]

    def log_probability(self, words: list[bytes], group: int = 20_000, long: int = 96) -> np.ndarray:
        """Natural log of the marginal probability of each word (behind the word mark)."""
        words = [MARK.encode() + w for w in words]
        sizes = np.asarray([len(w) for w in words], np.int64)
        out = np.zeros(len(words))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for a in range(0, len(rows), group):
                part = rows[a:a + group]
                if size > long:
                    out[part] = [self._one(words[k]) for k in part.tolist()]
                else:
                    out[part] = self._same_length(np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8).reshape(len(part), size))
        return out


def _count_bucket(path: str):
    schema = pa.schema([("tokens", pa.int64()), ("distinct", pa.int64()), ("piece", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def work(bucket: W.Bucket):
        n = bucket.counts()
        m = _model(path)
        total = np.zeros(m.get_piece_size(), np.int64)
        seen = np.flatnonzero(n)
        for a in range(0, len(seen), 20_000):
            part = seen[a:a + 20_000]
            ids = m.encode([bucket.words[k].decode() for k in part.tolist()], num_threads=1)
            total += np.bincount(np.concatenate([np.asarray(i, np.int64) for i in ids]), weights=np.repeat(n[part], [len(i) for i in ids]),
                                 minlength=len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([dict(tokens=int(n.sum()), distinct=len(seen), piece=used.tolist(), n=total[used].tolist())], schema=schema)
    return work


def _score_bucket(path: str, logp: np.ndarray):
    schema = pa.schema([("block", pa.int64()), ("crc", pa.int64()), ("idx", pa.binary()), ("c", pa.binary()), ("lp", pa.binary())])

    def work(bucket: W.Bucket):
        key = (path, logp.tobytes()[:64], len(logp))
        if _MODELS.get("lattice", (None,))[0] != key:
            _MODELS["lattice"] = key, Lattice(path, logp)
        c, lp = bucket.counts(), _MODELS["lattice"][1].log_probability(bucket.words)
        for row, _, word in bucket.owners():
            yield pa.RecordBatch.from_pylist([dict(block=row["block"], crc=row["crc"], idx=row["idx"], c=W.pack(c[word], "<i8"), lp=W.pack(lp[word], "<f8"))], schema=schema)
    return work


def _assemble(tokens: int, distinct: int, ends: int, end_logp: float):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def work(doc: dict, words: list[dict]) -> pa.Table:
        codes, sizes = W.unpack(doc["codes"], "<u4").astype(np.int64), np.asarray(doc["sizes"], np.int64)
        c, lp = np.full(int(codes.max()) + 1 if len(codes) else 0, -1, np.int64), np.zeros(int(codes.max()) + 1 if len(codes) else 0)
        for w in words:
            idx = W.unpack(w["idx"], "<u4")
            c[idx], lp[idx] = W.unpack(w["c"], "<i8"), W.unpack(w["lp"], "<f8")
        if (c < 0).any():
            raise ValueError("words of a block are missing")
        cut = np.concatenate(([0], np.cumsum(sizes)))
        over = tokens + distinct + 1.0

        def per_doc(values):  # exact segment by segment: no difference of running sums
            padded = np.append(values, 0.0)
            out = np.add.reduceat(padded, cut[:-1]) if len(sizes) else np.zeros(0)
            return np.where(sizes > 0, out, 0.0)
        base = per_doc(np.log10((c + 1) / over)[codes]) + np.log10((ends + 1) / over)
        score = (per_doc(lp[codes]) + end_logp) / np.log(10)
        known = per_doc((c > 0)[codes].astype(float)).astype(np.int64) + int(ends > 0)
        columns = [doc["doc_ids"], [not f for f in doc["flags"]], sizes + 1, known, np.full(len(sizes), tokens), base, score]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types)], names=names)
    return work


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, vocabulary: str | None = None, buckets: int | None = None) -> DataFrame:
    """Base and lattice log10 probability of every whole text of (doc_id, text), learnt from the rows not held out."""
    spark, path = docs.sparkSession, vocabulary_path(vocabulary)
    stage, buckets = Stage(spark, "lattice"), buckets or partitions(spark)
    flagged = W.flagged(docs, ~held_out(F.col("doc_id")))
    words = stage.keep(W.word_rows(flagged, lower_words, buckets), "words", codec="none")
    counted = stage.keep(W.by_bucket(words, buckets, _count_bucket(path), "tokens long, distinct long, piece array<int>, n array<long>"), "counts")
    ends = flagged.where("flag").count()
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # a row for each piece of the vocabulary at most
    pieces = (counted.select(F.explode(F.arrays_zip("piece", "n")).alias("x")).groupBy("x.piece").agg(F.sum("x.n").alias("n")).collect())
    m = _model(path)
    n = np.ones(m.get_piece_size())
    for piece, count in pieces:
        n[piece] += count
    n[m.eos_id()] += ends
    logp = np.log(n / n.sum())
    scored = W.by_bucket(words, buckets, _score_bucket(path, logp), "block long, crc long, idx binary, c binary, lp binary")
    work = _assemble(total[0] + ends, total[1] + (ends > 0), ends, float(logp[m.eos_id()]))
    return W.by_block(W.doc_rows(flagged, lower_words), scored, work,
                      "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
