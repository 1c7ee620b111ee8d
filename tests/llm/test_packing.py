import tracemalloc
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lynceus.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_hold_each_id_once(spark):
    texts = ["", None, "A b\x0bc d\x1ce", "Caf́e ÉtÉ it's DON'T <|endoftext|> <|ENDOFTEXT|>", "x\x01y \x01 \x01\x01 z", "wort... " * 5000,
             "a" * 5000 + "   " + "ßİΣ" * 50, "tab\tnew\nline\r\n  spaces", "wort... wort..."]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, "null key", 3)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, with_ids=True).toPandas()
    tok = Tokenizer.from_file(PATH)
    assert out.sequence_id.is_unique and (out.offset == 0).all()
    for i, t in enumerate(texts):
        own = out[out.doc_id == i].sort_values("start")
        if i == 3:
            assert len(own) == 2 * len(own.drop_duplicates("start"))
            own = own.drop_duplicates("start")
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        got = np.concatenate(list(own.ids)).tolist()
        assert got == want and set(own.doc_tokens) == {len(want)}
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert all(n <= 4096 and n & (n - 1) == 0 for n in own.length)
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids] == own.ids_crc32.tolist()
    assert out.doc_id.isna().sum() >= 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_of_a_large_vocabulary_are_learnt_once(monkeypatch):
    tok, learnt = packing.ChunkTokenizer(PATH), []
    learn = tok._learn
    monkeypatch.setattr(tok, "_learn", lambda chunks: (learnt.append(len(chunks)), learn(chunks)))
    letters = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(str(i).translate(letters) for i in range(250_000))
    first, again = (tok.encode([text])[0] for _ in range(2))
    assert learnt == [250_000] and (first == again).all()


def test_what_a_task_remembers_is_small_and_goes_before_its_worker_waits(monkeypatch):
    tok = packing.ChunkTokenizer(PATH)
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [str(i).translate(letters) for i in range(100_000, 140_000)]
    tracemalloc.start()
    tok.encode([" ".join(w + tail for w in words for tail in (",", "", "."))])
    held = tracemalloc.get_traced_memory()[0] / len(tok.code)
    tracemalloc.stop()
    assert len(tok.code) == 120_000 and held < 190, held

    alive, made = [], []
    new = packing.ChunkTokenizer.__init__
    monkeypatch.setattr(packing.ChunkTokenizer, "__init__", lambda self, *a: (made.append(weakref.ref(self)), new(self, *a))[1])
    for module in (common, packing):
        monkeypatch.setattr(module, "give_back_memory", lambda: alive.append(made[0]() is not None), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], ["key", "text"])
    assert sum(b.num_rows for b in packing.piece_batches(iter([batch]), PATH, 4096, True)) == 3
    assert not alive[-1]


def test_few_remembered_chunks_change_no_result(spark):
    texts = [" ".join(f"{w}{i % 7}, {w}x" for i, w in enumerate(f"word{k} {k} Caf\u00e9 wort...".split())) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = lambda **more: sorted(tuple(r)[:5] for r in packing.pack(docs, PATH, **more).collect())
    assert rows() == rows(remembered=50)
