import zlib

import numpy as np

from strandline.llm import queries as Q


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    from strandline.llm.token_files import token_files

    path = Q.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["hello <|startoftext|> x <|endoftext|> y", "a<|endoftext|>b <|ENDOFTEXT|> <|endoftext|>é", "<| endoftext|> plain words", "<|endoftext|><|endoftext|>", "don't <|endoftext|>'s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = 0
    for r in sorted(token_files(df, path).collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += r.n_tokens
