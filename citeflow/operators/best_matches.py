"""Block-wise exact top-k inside a task.

Scoring every (question, document) pair as a row would emit questions x documents rows. Here a task
scores a block of documents against a block of questions as one matrix product and keeps only rows
that can still be among a question's best ``k``; each task emits at most ``k`` rows per question.
Scores are whole numbers of 1e-9, held exactly in float64, so the order never depends on the
grouping of the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

UNITS = 1_000_000_000
OUTPUT = "qid bigint, chunk_id bigint, score_units bigint"
# cells of one dense block: 1M float64 = 8 MB; several of that size are held at a time
BLOCK_CELLS = 1_000_000
PENDING_ROWS = 1_000_000
# A term that a document has and a question asks for in this share of all pairs is scored by matrix product; the matrix
# of questions by such terms has at most so many cells and terms.
DENSE_SHARE = 0.005
DENSE_CELLS, DENSE_TERMS = 8_000_000, 512
LEAST_DOCS = 32  # documents of a block, however many questions there are


class BestMatches:
    """Running best ``k`` per question by score descending, then document id ascending.

    ``floor`` holds a score per question that at least ``k`` documents are known to reach; lower ones
    cannot be in the result. It rises as documents come in.
    """

    def __init__(self, n_questions: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n_questions, -np.inf) if floor is None else floor.copy()
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def offer(self, ids: np.ndarray, scores: np.ndarray, asked: np.ndarray, matched=None) -> None:
        """``scores`` is documents x questions; ``asked`` numbers its questions."""
        if len(ids) > self.k and np.isneginf(self.floor[asked]).any():
            # the block itself shows a score that k of its documents reach
            kth = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
            self.floor[asked] = np.maximum(self.floor[asked], kth)
        # a score equal to the floor may still win by its id, so it stays
        keep = scores >= self.floor[asked]
        if matched is not None:
            keep &= matched
        doc, question = np.nonzero(keep)
        if len(doc):
            self.held.append((asked[question], ids[doc], scores[doc, question]))
            self.pending += len(doc)
            if self.pending > PENDING_ROWS:
                self.compact()

    def compact(self) -> None:
        if not self.held:
            return
        question, ids, scores = (np.concatenate(part) for part in zip(*self.held))
        order = np.lexsort((ids, -scores, question))
        question, ids, scores = question[order], ids[order], scores[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        last = place == self.k - 1
        self.floor[question[last]] = np.maximum(self.floor[question[last]], scores[last])
        keep = place < self.k
        self.held = [(question[keep], ids[keep], scores[keep])]
        self.pending = 0

    def rows(self, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.compact()
        for question, ids, scores in self.held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[question]), pa.array(ids), pa.array(scores.astype(np.int64))],
                names=["qid", "chunk_id", "score_units"],
            )


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(
        zero_copy_only=False
    ).astype(np.int64)


def vector_scorer(qids: np.ndarray, questions: np.ndarray, k: int, floor=None):
    """Scores ``(chunk_id, vector)`` batches by the dot product with each question vector."""
    dim = questions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestMatches(len(qids), k, floor)
        q_step = max(1, min(len(qids), 1024))
        d_step = max(1, BLOCK_CELLS // max(q_step, dim))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values, lengths = flat_lists(batch.column(1))
            if not (lengths == dim).all():
                raise ValueError(f"every vector must have {dim} numbers")
            matrix = values.astype(np.float64, copy=False).reshape(len(ids), dim)
            for d in range(0, len(ids), d_step):
                for q in range(0, len(qids), q_step):
                    scores = matrix[d : d + d_step] @ questions[q : q + q_step].T
                    asked = np.arange(q, q + scores.shape[1])
                    best.offer(ids[d : d + d_step], np.rint(scores * UNITS), asked)
        yield from best.rows(qids)

    return run


def cells_of(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Cell number of each vector: one bit per plane, set on its positive side."""
    return ((vectors @ planes.T) > 0) @ (1 << np.arange(len(planes)))


def probed_cells(vectors: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` cells nearest to each vector: those that differ from its own cell only at
    planes it lies close to."""
    sides = vectors @ planes.T
    bits = (np.arange(1 << len(planes))[:, None] >> np.arange(len(planes))) & 1
    cost = np.abs(sides) @ bits.T.astype(np.float64)
    other = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return cells_of(vectors, planes)[:, None] ^ other


def cell_scorer(
    qids: np.ndarray, questions: np.ndarray, planes: np.ndarray, probes: int, k: int, floor=None
):
    """As `vector_scorer`, but a question meets only the documents of its probed cells."""
    dim = questions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestMatches(len(qids), k, floor)
        probed = probed_cells(questions, planes, probes)
        order = np.argsort(probed, axis=None, kind="stable")
        owner, cell_list = order // probed.shape[1], probed.ravel()[order]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values, _ = flat_lists(batch.column(1))
            matrix = values.astype(np.float64).reshape(len(ids), dim)
            cells = cells_of(matrix, planes)
            for cell in np.unique(cells):
                low, high = np.searchsorted(cell_list, [cell, cell + 1])
                asked = owner[low:high]
                if not len(asked):
                    continue
                docs = np.flatnonzero(cells == cell)
                step = max(1, BLOCK_CELLS // len(asked))
                for d in range(0, len(docs), step):
                    part = docs[d : d + step]
                    scores = matrix[part] @ questions[asked].T
                    best.offer(ids[part], np.rint(scores * UNITS), asked)
        yield from best.rows(qids)

    return run


class TermScores:
    """Sums BM25 weights of matching terms. Questions are an inverted list from term to questions, so only entries whose term
    a question asks for cost anything. Terms that match a good part of all pairs are columns of a matrix instead; weights are
    whole numbers, so both ways give the same sums exactly."""

    def __init__(self, qids, offsets, terms, idf, mean_length, k, k1, b, floor=None):
        self.qids, self.idf, self.mean_length, self.k1, self.b = qids, idf, mean_length, k1, b
        order = np.argsort(terms, kind="stable")
        self.owner = np.repeat(np.arange(len(qids)), np.diff(offsets))[order]
        self.ptr = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        n = max(len(qids), 1)
        # exp(-idf) is close to the share of documents that hold the term
        share = np.diff(self.ptr) / n * np.exp(-np.asarray(idf, np.float64))
        often = np.argsort(-share, kind="stable")[: min(DENSE_TERMS, DENSE_CELLS // n)]
        often = often[share[often] >= DENSE_SHARE]
        self.column = np.full(len(idf), -1)
        self.column[often] = np.arange(len(often))
        self.asks = np.zeros((len(often), len(qids)))
        for i, t in enumerate(often):
            self.asks[i] = np.bincount(self.owner[self.ptr[t] : self.ptr[t + 1]], minlength=len(qids))
        self.best = BestMatches(len(qids), k, floor)

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Entries of documents: ``doc`` numbers ``ids`` and does not fall; ``lengths`` are of the documents."""
        n = len(self.qids)
        norm = self.k1 * (1 - self.b + self.b * lengths.astype(np.float64) / self.mean_length)
        weight = np.rint(self.idf[term] * (tf * (self.k1 + 1) / (tf + norm[doc])) * UNITS)
        # what rounds to nothing matches all the same, which a sum cannot show
        thick = (self.column[term] >= 0) & (weight > 0)
        wide, doc_of, heavy = self.column[term[thick]], doc[thick], weight[thick]
        term, doc, weight = term[~thick], doc[~thick], weight[~thick]
        pairs = np.concatenate([[0], np.cumsum(self.ptr[term + 1] - self.ptr[term])])
        step = max(LEAST_DOCS, BLOCK_CELLS // max(n, 1))
        columns = len(self.asks)
        for d in range(0, len(ids), step):
            stop = min(d + step, len(ids))
            a, z = np.searchsorted(doc_of, [d, stop])
            if a < z:
                cells = (doc_of[a:z] - d) * columns + wide[a:z]
                held = np.bincount(cells, heavy[a:z], (stop - d) * columns).reshape(stop - d, columns)
                scores = (held @ self.asks).ravel()
            else:
                scores = np.zeros((stop - d) * n)
            hits = scores > 0
            first, end = np.searchsorted(doc, [d, stop])
            while first < end:
                last = min(end, max(first + 1, int(np.searchsorted(pairs, pairs[first] + BLOCK_CELLS, "right")) - 1))
                each = np.diff(pairs[first : last + 1])
                place = np.repeat(self.ptr[term[first:last]] - (pairs[first:last] - pairs[first]), each) + np.arange(
                    pairs[last] - pairs[first]
                )
                cell = np.repeat((doc[first:last] - d) * n, each) + self.owner[place]
                scores += np.bincount(cell, np.repeat(weight[first:last], each), len(scores))
                # a weight can round to nothing only on huge corpora; such documents still match
                hits[cell] = True
                first = last
            shape = (stop - d, n)
            self.best.offer(ids[d:stop], scores.reshape(shape), np.arange(n), hits.reshape(shape))

    def rows(self) -> Iterator[pa.RecordBatch]:
        return self.best.rows(self.qids)


def term_scorer(*state):
    """Scores ``(chunk_id, length, term ids, term counts)`` batches by BM25; ``state`` is that of `TermScores`, in which
    ``terms[offsets[i]:offsets[i+1]]`` are the distinct term ids of question ``i``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TermScores(*state)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            term, per_doc = flat_lists(batch.column(2))
            tf, _ = flat_lists(batch.column(3))
            doc = np.repeat(np.arange(len(ids)), per_doc)
            scores.add(ids, batch.column(1).to_numpy(zero_copy_only=False), doc, term.astype(np.int64), tf)
        yield from scores.rows()

    return run


def range_scorer(*state):
    """As `term_scorer`, over postings ``(range, term, chunk ids, term counts, lengths)`` in order of ranges: the postings of a
    range are turned into its documents, whatever batches they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, held, at = TermScores(*state), [], None

        def score() -> None:
            term, ids, tf, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            known, first, doc = np.unique(ids, return_index=True, return_inverse=True)
            order = np.argsort(doc, kind="stable")
            scores.add(known, lengths[first], doc[order], term[order], tf[order].astype(np.float64))
            held.clear()

        for batch in batches:
            ranges = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]])
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if held and ranges[a] != at:
                    score()
                at = ranges[a]
                part = batch.slice(a, z - a)
                ids, each = flat_lists(part.column(2))
                term = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), each)
                held.append((term, ids, flat_lists(part.column(3))[0], flat_lists(part.column(4))[0]))
        if held:
            score()
        yield from scores.rows()

    return run
