"""Pieces of all texts against a brute-force split."""

import hashlib

from lodestream.plans import catalog


def pieces(text, left=3):
    todo, out = [(text, left)], []
    while todo:
        s, n = todo.pop(0)
        if len(s) <= 4000 or n == 0:
            out.append(s)
            continue
        at = max((i for i in range(1, len(s) // 2) if s[i] == " "), default=len(s) // 2)
        todo[:0] = [(s[:at].strip(), n - 1), (s[at:].strip(), n - 1)]
    return out


def test_pieces_of_all_texts(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r.doc_id, k, len(p), hashlib.md5(p.encode()).hexdigest()) for r in texts if r.text is not None for k, p in enumerate(pieces(r.text)))
    assert max(k for _, k, *_ in expected) > 0
    assert sorted(map(tuple, catalog.QUERIES["t32_split_texts"](spark, sf).collect())) == expected
