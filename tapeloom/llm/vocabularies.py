"""Public tokenizer vocabularies; the folder is a parameter and files are read on the driver or a worker."""

from __future__ import annotations

import ast
import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files.
FOLDER = os.environ.get("TAPELOOM_TOKENIZERS", "/opt/tokenizers")


@lru_cache(2)
def pieces(folder: str = FOLDER, name: str = "piece_bpe_32k.model") -> list[str]:
    """All pieces of a SentencePiece model in id order; byte pieces look like <0x41>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


@lru_cache(2)
def byte_bpe(folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken"):
    """A byte-level BPE encoder that treats special-token strings as ordinary text."""
    import tiktoken

    with open(f"{folder}/__init__.py", encoding="utf-8") as source:  # the splitting pattern stands there as a literal; nothing is run
        said = {n.targets[0].id: n.value for n in ast.parse(source.read()).body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name)}
    pattern = ast.literal_eval(said["PATTERN"])
    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
