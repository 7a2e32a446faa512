"""The licence scan in plain Python, without an index: every offset of every template in every file."""

from __future__ import annotations

from tessera.llm import licenses


def licence_labels(texts: dict) -> dict:
    """doc_id -> words, labels, score."""
    words = {d: licenses.words_of(t or "") for d, t in texts.items()}
    files = {w: sum(w in set(s) for s in words.values()) for w in licenses.VOCABULARY}
    postings = []
    for _, text, _ in licenses.TEMPLATES:
        own = licenses.words_of(text)
        rare = set(sorted(set(own), key=lambda w: (files[w], w))[: min(licenses.INDEXED, (len(set(own)) + 1) // 2)])
        postings.append([(i, w) for i, w in enumerate(own) if w in rare])
    out = {}
    for d, w in words.items():
        flat = f" {' '.join(w)} "
        labels = {licenses.BASE[p] for p in licenses.BASE if f" {p} " in flat}
        score = float(bool(labels))
        for (label, _, key), at in zip(licenses.TEMPLATES, postings, strict=True):
            if f" {key} " in flat:
                share = max(sum(0 <= begin + i < len(w) and w[begin + i] == x for i, x in at) / len(at) for begin in range(-at[-1][0], len(w)))
                if share >= licenses.AGREE:
                    labels.add(label)
                    score = max(score, share)
        out[d] = (len(w), ",".join(sorted(labels)), round(min(1.0, score), 9))
    return out
