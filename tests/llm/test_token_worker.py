"""What tasks of one worker share when they write token files, and what a worker holds."""

import random
import sys
import tracemalloc

import pyarrow as pa
from tokenizers import Tokenizer

from wiretally.llm import bpe, common, token_files

from test_operators import WORD_BPE


def test_tasks_of_a_worker_share_a_vocabulary():
    vocabulary = token_files.library_vocabulary(WORD_BPE)
    first = vocabulary.encode("a worker meets words again")
    assert token_files.library_vocabulary(WORD_BPE) is vocabulary and vocabulary.encode("a worker meets words again") == first and vocabulary.pieces


def test_caches_are_bounded_by_bytes_too(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(bpe, "CACHED_WORD_BYTES", 1 << 19, raising=False)
    draw, library = random.Random(3), Tokenizer.from_file(WORD_BPE)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=150)) + " " + "".join(draw.choices([chr(c) for c in range(0x4E00, 0x5E00)], k=120)) for _ in range(4000)]
    size = lambda cache: sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in cache.items())
    for kind in (bpe.Vocabulary, token_files.LibraryVocabulary):
        vocabulary = kind(WORD_BPE)
        for i, text in enumerate(texts):
            ids = vocabulary.encode(text)
            if i % 400 == 0:
                assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
        assert 0 < size(vocabulary.pieces) < 1.01 * (1 << 20) and 0 < size(vocabulary.old_pieces) < 1.01 * (1 << 20)
        assert 0 < size(vocabulary.seen) < 1.01 * (1 << 19) and 0 < size(vocabulary.old_seen) < 1.01 * (1 << 19)


def test_few_texts_of_a_batch_are_strings_at_once():
    texts = [None if i % 7 == 0 else f"{i} " * 4000 for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, 1000)], pa.int64()), "text": pa.array(texts)})
    tracemalloc.start()
    lengths = [(doc_id, len(text)) for doc_id, text in common.texts_of(batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths == [(i or None, len(text or "")) for i, text in enumerate(texts)]
    assert peak < 4e6 < sum(len(x or "") for x in texts)
    assert list(common.texts_of(batch.slice(0, 0))) == []
