"""Column-level building blocks; all but plugged tokenizers run inside the JVM."""

from pentarank.functions import arrays, pictures, prompts, subwords, text, tokens, vectors

__all__ = ["arrays", "pictures", "prompts", "subwords", "text", "tokens", "vectors"]
