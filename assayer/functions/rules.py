"""Detection rules as data, and columns that apply them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    severity: str = "high"
    flags: str = "i"
    re2: str | None = None  # for engines without look-around
    #: One of these is in every text that matches: a cheap test before the pattern.  Lower case, without the letters i, s
    #: and k, which stand for others too where case doesn't count.
    hints: tuple[str, ...] = ()

    def matches(self, text: Column) -> Column:
        out = text.rlike(self.java)
        if self.hints:
            low = F.lower(text) if any(c.isalpha() for h in self.hints for c in h) else text
            some = low.contains(self.hints[0])
            for h in self.hints[1:]:
                some = some | low.contains(h)
            out = some & out
        return out

    @property
    def java(self) -> str:
        """The pattern for Spark, with the line and character classes of Unicode text."""
        flags = "".join(f + ("u" if f == "i" else "") for f in self.flags)
        return f"(?dU{flags}){self.pattern}"

    @property
    def sql(self) -> str:
        return (f"(?{self.flags})" if self.flags else "") + (self.re2 or self.pattern)


# The patterns below decide what counts as a finding and must stay as they are.
RULES_FILE = (
    Rule("hidden_comment_instruction", r"<!--[^\n]{0,400}?(?:ignore|forget|disregard|override|bypass|system prompt|you are now|act as|pretend)[^\n]{0,400}?-->", hints=("<!--",)),
    Rule("encoded_payload", "(?<![A-Za-z0-9+/_'\"`])[A-Za-z0-9+/]{50,}={0,2}(?![A-Za-z0-9+/_'\"`])", "low", "", "(?:^|[^A-Za-z0-9+/_'\"`])[A-Za-z0-9+/]{50,}={0,2}(?:[^A-Za-z0-9+/_'\"`]|$)"),
    Rule("direct_injection", r"(?:ignore|forget|disregard)\s+(?:all\s+)?(?:previous|above|prior)\s+(?:instructions|prompts|rules|context)", hints=("gnore", "forget", "regard")),
    Rule("system_override", r"(?:you are now|act as|pretend to be|your new role|system:\s*you are)", hints=("you are", "act a", "pretend to be", "your new role")),
    Rule("exfiltration_instruction", r"(?:send|post|upload|transmit|exfiltrate)\s+(?:all\s+)?(?:data|code|files|content|tokens|keys)\s+to"),
    Rule("code_execution", r"(?:execute|run|eval|exec|subprocess|os\.system|__import__)\s*\(", hints=("(",)),
    Rule("credential_harvest", r"(?:collect|harvest|extract|steal|send)\s+(?:all\s+)?(?:api[_-]?keys?|tokens?|passwords?|secrets?|credentials?)"),
)
COMPANION = (
    Rule("hardcoded_api_key", r'(?:"api[_-]?key"|"apikey"|"access[_-]?key"|"secret[_-]?key"|"auth[_-]?token"|"bearer")\s*:\s*"[a-zA-Z0-9_\-]{20,}"', hints=(":",)),
    Rule("hardcoded_aws_credentials", r"(?:AKIA[0-9A-Z]{16}|aws[_-]?access[_-]?key[_-]?id|aws[_-]?secret[_-]?access[_-]?key)"),
    Rule("hardcoded_private_key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", flags="", hints=("-----",)),
    Rule("hardcoded_password", r'(?:"password"|"passwd"|"pwd")\s*:\s*"[^"]{8,}"', hints=(":",)),
    Rule("trust_remote_code_enabled", r'"trust[_-]?remote[_-]?code"\s*:\s*true', hints=(":",)),
    Rule("auto_map_config", r'"auto[_-]?map"\s*:\s*\{', "low", hints=("{",)),
    Rule("remote_from_url", r"^FROM\s+https?://", flags="im", hints=("://",)),
    Rule("discord_slack_webhook", r"https?://(?:discord|slack)\.com/api/webhooks/", hints=("://",)),
    Rule("data_exfiltration_url", r'https?://[^\s"]+\?(?:data|token|key|secret|password|auth)=[^\s"]+', hints=("://",)),
)
MODEL_CARD = (
    Rule("credential_harvest_doc", r"(?:send|post|upload|transmit|exfiltrate|provide|submit|enter)\s+(?:your|all|the)\s+(?:api[_\s-]?key|token|password|secret|credential)"),
    Rule("suspicious_shortened_url", r"https?://(?:bit\.ly|tinyurl\.com|t\.co|goo\.gl|is\.gd|rb\.gy)", hints=("://",)),
)
METADATA = (
    Rule("metadata_address", r"https?://", "low"),
    Rule("metadata_eval", r"eval\s*\(", "low"),
    Rule("metadata_exec", r"exec\s*\(", "low"),
    Rule("metadata_shell", r"os\.system", "low"),
    Rule("metadata_process", "subprocess", "low"),
    Rule("metadata_import", "__import__", "low"),
    Rule("metadata_socket", r"socket\.", "low"),
)
SUPPLY_CHAIN = (
    Rule("impossible_quantization", r"(?:Q0_[KS]|Q0_0|Q1_[KS])", hints=("q0_", "q1_")),
    Rule("suspicious_file_type", r"\.(?:exe|bat|cmd|ps1|sh|py|js|vbs|wsf)$"),
)
RUNTIME_FLAGS = (
    Rule("bind_all_interfaces", r"--host\s+0\.0\.0\.0", hints=("--",)),
    Rule("api_key_in_args", r"--api-key\s+\S+", hints=("--",)),
)
TEMPLATE_TEXT = (
    Rule("poison_dangerous_function", r"(?:os\.system|os\.environ|subprocess\.|__import__|eval\(|exec\(|compile\()", hints=("(", ".", "__")),
    Rule("poison_unicode_tag_smuggling", r"[\x{E0020}-\x{E007F}]+", "low", ""),
    Rule("poison_zero_width_characters", r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}-\x{2064}]+", "low", ""),
)
URL_ALLOWED_KEYS = ("general.source.url", "general.url", "general.license.link", "general.homepage", "general.repository", "general.documentation", "general.base_model.repo")
# End of fixed values.

FAMILIES = {"rules_file": RULES_FILE, "companion": COMPANION, "model_card": MODEL_CARD, "metadata": METADATA, "supply_chain": SUPPLY_CHAIN, "runtime_flags": RUNTIME_FLAGS, "template_text": TEMPLATE_TEXT}
#: Families of which only the first matching rule of a text counts.
FIRST_ONLY = frozenset({"rules_file", "metadata"})


def hits(text: Column, rules: tuple[Rule, ...], first_only: bool = False) -> Column:
    """Array of (rule, severity, seq) for the rules that a text matches; null text matches none."""
    made = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(i).alias("seq")) for i, r in enumerate(rules)]
    if first_only:
        out = F.lit(None).cast("struct<rule:string,severity:string,seq:int>")
        for r, m in reversed(list(zip(rules, made))):
            out = F.when(r.matches(text), m).otherwise(out)
        return F.array_compact(F.array(out))
    return F.array_compact(F.array(*(F.when(r.matches(text), m) for r, m in zip(rules, made))))


def metadata_hit(key: Column, value: Column) -> Column:
    """The first matching metadata rule of a string value; addresses may stand under the keys that are for them."""
    rest = hits(value, METADATA[1:], first_only=True)
    return F.when(~key.isin(*URL_ALLOWED_KEYS), hits(value, METADATA, first_only=True)).otherwise(rest)
