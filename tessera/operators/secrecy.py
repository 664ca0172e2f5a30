"""Screening of contents for secrets before anything of them is shown.

Each rule has words without which it can't match: a file that has none of them
isn't searched by the rule's pattern. What stands where the secret would be may be
a placeholder, which is no finding, unless a quoted text of eight characters or
more follows on the line. In source code an assignment counts only where a quote
opens its value or such a text follows: other values are expressions. A null
content, one that isn't valid UTF-8, and one beyond the limit are indeterminate,
and what is indeterminate is withheld like what is sensitive.

All of it is built-in functions; only ids of rules and numbers leave it, never text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes beyond which a content isn't searched.
LIMIT = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``pattern`` has one group around the secret; ``assigned`` rules allow placeholders and expressions."""

    name: str
    words: tuple[str, ...]
    pattern: str
    assigned: bool = False


# The rules, and what a placeholder looks like.
RULES = (
    Rule("secret.private-key-envelope", ("private key",), r"(-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----)"),
    Rule("secret.authorization-header", ("authorization",), r"(?i)authorization[ \t]*[:=][ \t]*(?:bearer|basic)[ \t]+([A-Za-z0-9._~+/=-]{8,})"),
    Rule("secret.provider-token", ("gh",), r"(gh[pousr]_[A-Za-z0-9]{36,})"),
    Rule("secret.context-assignment", ("key", "secret", "token", "password", "passwd", "pwd"), r"""(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|client[_-]?secret)[ \t]*[:=][ \t]*(?:\[[ \t]*)?(?:(?:["'][^"'\n]{0,7}["'][ \t]*,[ \t]*)+["']|["']?)([^\s"'#]{8,})""", True),
    Rule("secret.uri-credentials", ("://",), r"://[^/\s:@]+:([^@\s/]{4,})@"),
)
PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "change-me", "change_me", "redacted", "replace-me", "replace_me", "dummy", "fake", "test-value")
_EXPRESSION = r"^(?:\$\{\{[^{}]+\}\}|\{\{[^{}]+\}\}|\$\{[^{}]+\})+$"
_PAYLOAD = r"""["'`][^"'`\n]{8,}["'`]"""


def is_placeholder(secret: Column) -> Column:
    bare = F.lower(F.regexp_replace(secret, r"""^["'`<>\[\]]+|["'`<>\[\]]+$""", ""))
    return bare.isin(*PLACEHOLDERS) | bare.startswith("your_") | bare.startswith("your-") | bare.rlike(_EXPRESSION)


def findings(rule: Rule, text: Column, code: Column) -> Column:
    """How often a rule finds something in a text; ``code`` tells whether it is source code."""
    worth = F.lit(False)
    for w in rule.words:
        worth = worth | F.lower(text).contains(w)
    if not rule.assigned:
        return F.when(worth, F.regexp_count(text, F.lit(rule.pattern))).otherwise(0)
    # the secret, and what is left of its line, which isn't consumed
    with_rest = F.lit(rule.pattern + r"(?=([^\n]*))")
    whole, secrets, rests = (F.regexp_extract_all(text, with_rest, F.lit(i)) for i in (0, 1, 2))
    met = F.arrays_zip(whole.alias("whole"), secrets.alias("secret"), rests.alias("rest"))

    def counts(m: Column) -> Column:
        payload = m["rest"].rlike(_PAYLOAD)
        quoted = F.substring(m["whole"], -F.length(m["secret"]) - 1, F.lit(1)).isin('"', "'")
        return F.when(is_placeholder(m["secret"]), payload).when(code, quoted | payload).otherwise(F.lit(True))

    return F.when(worth, F.size(F.filter(met, counts))).otherwise(0)


def screen(files: DataFrame, *, code: Column | None = None, rules: tuple[Rule, ...] = RULES, limit: int = LIMIT) -> DataFrame:
    """(path, state, rule_ids, findings, withheld) of files (path, content): clean, sensitive or indeterminate."""
    text = F.col("content").cast("string")
    readable = F.col("content").isNotNull() & F.is_valid_utf8(text) & (F.octet_length("content") <= limit)
    source = F.lit(False) if code is None else F.coalesce(code, F.lit(False))
    counted = files.select("path", readable.alias("_readable"), *[F.when(readable, findings(r, text, source)).otherwise(0).alias(f"_{i}") for i, r in enumerate(rules)])
    total = sum((F.col(f"_{i}") for i in range(len(rules))), F.lit(0)).cast("long")
    ids = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{i}") > 0, r.name) for i, r in enumerate(rules)])), ",")
    state = F.when(~F.col("_readable"), "indeterminate").when(total > 0, "sensitive").otherwise("clean")
    return counted.select("path", state.alias("state"), ids.alias("rule_ids"), total.alias("findings"), (state != "clean").alias("withheld"))
