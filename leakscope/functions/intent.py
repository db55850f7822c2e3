"""Request intent by path and body shape: one CASE cascade, first rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.dialect import jvm_regex
from leakscope.functions.text import looks_binary, looks_chat

# --- fixed values ------------------------------------------------------------
INTENTS = ("chat", "telemetry", "antiabuse", "handshake", "auth", "unknown")
FACTOR = {"chat": 1.0, "auth": 1.0, "unknown": 1.0,
          "handshake": 0.45, "telemetry": 0.35, "antiabuse": 0.25}
DEMOTED = ("telemetry", "antiabuse", "handshake")   # label is held at low
TELEMETRY_PATHS = (
    r"^/api/event_logging/", r"^/api/eval/", r"^/ces/v1/(?:t|m|p|rgstr|telemetry)\b",
    r"^/ces/statsc/", r"/telemetry/intake\b", r"^/v1/telemetry", r"/segment\.io/",
    r"/analytics/v1/", r"/metrics/(?:flush|intake|batch)\b", r"/(?:rum|otlp|stats)/",
    r"/ingest/(?:event|metric)",
)
ANTIABUSE_PATHS = (r"/sentinel/", r"/turnstile/", r"/recaptcha/", r"/chat-requirements/",
                   r"/pow/", r"/challenge\b")
HANDSHAKE_PATHS = (
    r"/conversation/(?:prepare|init|finalize)\b", r"/conversations/init\b",
    r"^/backend-anon/f/conversation/(?:prepare|init|finalize)\b",
)
CHAT_PATHS = (
    r"^/v1/messages\b", r"^/v1/chat/completions\b", r"^/v1/responses\b", r"^/v1/complete\b",
    r"^/v1beta/.*generateContent\b", r"^/api/chat\b",
    r"^/backend-(?:api|anon)/(?:f/)?conversation(?:/[^/]+)?$",
    r"^/backend-(?:api|anon)/conversation\b",
)
AUTH_PATHS = (r"/oauth(?:2)?/", r"/token\b", r"/login\b", r"/signin\b", r"/v1/api[_-]?keys\b",
              r"/auth/(?:login|refresh|exchange)\b")
SEALED_PREFIX = "gAAAAA"      # start of a sealed (encrypted) token
GUESS_ACCEPT = 0.55           # a model guess below this is no answer
GUESS_CEILING = 0.85


def path_matches(path: str, patterns: tuple[str, ...]) -> Column:
    return F.rlike(F.coalesce(F.col(path), F.lit("")),
                   F.lit(jvm_regex("(?i)" + "|".join(patterns))))


def classify_intent(path: str, text: str, body: str | None = None,
                    guess: str | None = None, guess_prob: str | None = None) -> Column:
    """struct<intent, confidence, factor, ceiling>.

    ``body`` names the raw bytes where they are kept apart from ``text``; ``guess`` and
    ``guess_prob`` the answer of a trained fallback, consulted when no rule fires.
    """
    shown = F.coalesce(F.col(text), F.lit(""))
    sniffed = looks_binary(body or f"cast({text} AS binary)")
    chat_shaped = looks_chat(text)

    def rule(intent: str, confidence: float) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"))

    cascade = (
        F.when(path_matches(path, ANTIABUSE_PATHS), rule("antiabuse", 0.95))
        .when(path_matches(path, TELEMETRY_PATHS), rule("telemetry", 0.95))
        .when(F.startswith(shown, F.lit(SEALED_PREFIX)) | sniffed, rule("antiabuse", 0.7))
        .when(path_matches(path, AUTH_PATHS), rule("auth", 0.9))
        .when(path_matches(path, HANDSHAKE_PATHS) & ~chat_shaped, rule("handshake", 0.9))
        .when(path_matches(path, CHAT_PATHS), rule("chat", 0.95))
        .when(chat_shaped, rule("chat", 0.7))
    )
    if guess is not None:
        cascade = cascade.when(
            F.col(guess).isin(*INTENTS) & (F.col(guess_prob) >= GUESS_ACCEPT),
            F.struct(F.col(guess).alias("intent"),
                     F.least(F.col(guess_prob), F.lit(GUESS_CEILING)).alias("confidence")))
    return cascade.otherwise(rule("unknown", 0.4))


def intent_factor(intent: Column) -> Column:
    chain = F.lit(1.0)
    for name in DEMOTED:
        chain = F.when(intent == name, F.lit(FACTOR[name])).otherwise(chain)
    return chain


def is_demoted(intent: Column) -> Column:
    return intent.isin(*DEMOTED)
