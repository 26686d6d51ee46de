"""Product analytics for clickstream events, expressed as Spark DataFrame operators."""

from clickspan.session import build_session
from clickspan.vocabulary import DEFAULT_VOCABULARY, Vocabulary

__all__ = ["DEFAULT_VOCABULARY", "Vocabulary", "build_session"]
