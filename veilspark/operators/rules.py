"""Detection rules as data: patterns, priorities, placeholder prefixes, validators, allow lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checks


@dataclass(frozen=True)
class Rule:
    """One rule. ``kind``: regex, parametric (its pattern is built from a run-time value), recogniser (second layer) or allow."""

    name: str
    kind: str
    category: str
    pattern: str | None
    prefix: str
    priority: int
    flags: str = ""
    validator: str | None = None
    entity: str | None = None
    score: float = 0.85
    active: bool = True
    #: Strings of which every match holds one; texts without any are not searched by the pattern.
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        """The pattern for Spark's regular expressions; case-insensitive ones also fold letters outside ASCII."""
        return self._flags + (java_pattern(self.pattern) if self.pattern else "")

    @property
    def _flags(self) -> str:
        flags = "".join(f for f in ("i", "s", "m") if f in self.flags)
        return f"(?{flags}{'u' if 'i' in flags else ''})" if flags else ""

    @property
    def narrowed(self) -> tuple[str, int] | None:
        """For a pattern with the group ``(?P<deger>...)``, which a finding is narrowed to: the pattern with all before the group as group 1, and the group's number."""
        place = _value_group(self.pattern or "")
        if place is None or not place[1]:
            return None
        before, number = self.pattern[: place[0]], place[2]
        head = java_pattern(self.pattern, 1)
        cut = len(java_pattern(before, 1, self.pattern))
        return f"{self._flags}({head[:cut]}){head[cut:]}", number + 1

    @property
    def by_python(self) -> bool:
        """Whether the group that a finding is narrowed to stands in another group or an alternative."""
        place = _value_group(self.pattern or "")
        return place is not None and not place[1]


#: The group that findings are narrowed to.
VALUE_GROUP = "deger"
_PIECE = re.compile(r"\\(?:[1-9][0-9]?|.)|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?|[()|]|.", re.S)


def _group_numbers(pattern: str) -> dict[str, int]:
    numbers, n = {}, 0
    for m in _PIECE.finditer(pattern):
        if m[1] or m[0] == "(":
            n += 1
        if m[1]:
            numbers[m[1]] = n
    return numbers


def _value_group(pattern: str) -> tuple[int, bool, int] | None:
    """Where the value's group begins, whether it stands alone at the top of the pattern, and its number; None if there is none."""
    depth, place, alone, bars = 0, None, True, False
    for m in _PIECE.finditer(pattern):
        if m[1] == VALUE_GROUP:
            place, alone = m.start(), depth == 0
        if m[0][0] == "(" and not m[2]:
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif m[0] == "|" and depth == 0:
            bars = True
    return None if place is None else (place, alone and not bars, _group_numbers(pattern)[VALUE_GROUP])


def java_pattern(pattern: str, shift: int = 0, whole: str | None = None) -> str:
    """A Python pattern for Java: named groups and references to them by number, each number up by ``shift``; ``whole`` is the pattern that names stand in, if this is its beginning."""
    numbers, out = _group_numbers(whole or pattern), []
    for m in _PIECE.finditer(pattern):
        piece = m[0]
        if m[1]:
            piece = "("
        elif m[2]:
            piece = f"(?:\\{numbers[m[2]] + shift})"
        elif len(piece) > 1 and piece[0] == "\\" and piece[1:].isdigit():
            piece = f"(?:\\{int(piece[1:]) + shift})"
        elif piece == "\\Z":
            piece = "\\z"
        out.append(piece)
    return "".join(out)


# Names, patterns, priorities and prefixes that results are compared by.
RULES: tuple[Rule, ...] = (
    Rule("project_name", "parametric", "project_name", None, "mask_proje_adi", 1),
    Rule("personnel_no", "parametric", "sicil_no", None, "mask_personel_no", 2),
    Rule("branch_name", "parametric", "branch_name", None, "mask_branch", 3),
    Rule("private_key_block", "regex", "secret", r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----.*?-----END \1-----", "mask_private_key", 5, "s", needs=("PRIVATE KEY",)),
    Rule("aws_access_key", "regex", "secret", r"\bAKIA[0-9A-Z]{16}\b", "mask_aws_key", 10, needs=("AKIA",)),
    Rule("google_api_key", "regex", "secret", r"\bAIza[0-9A-Za-z_-]{35}\b", "mask_google_api_key", 11, needs=("AIza",)),
    Rule("github_token", "regex", "secret", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b", "mask_github_token", 12, needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", "regex", "secret", r"\bxox[baprs]-[A-Za-z0-9-]{10,72}\b", "mask_slack_token", 13, needs=("xox",)),
    Rule("stripe_api_key", "regex", "secret", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,99}\b", "mask_stripe_key", 14, needs=("_live_", "_test_")),
    Rule("jwt_token", "regex", "secret", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "mask_jwt_token", 15, needs=("eyJ",)),
    Rule("generic_secret_assignment", "regex", "secret", r"""(?:(?<![A-Za-z0-9_])|(?<=_))(?:[A-Za-z0-9]+_)*(?:api[_-]?key|secret|token|password|passwd)(?:_[A-Za-z0-9]+)*\b\s*[:=]\s*(?:"[^"\n]{12,}"|'[^'\n]{12,}'|[^\s'"(){}\[\],;.]{12,})""", "mask_secret", 20, "i"),
    Rule("http_basic_auth_credentials", "regex", "credential", r"""(?<=://)[^\s/@'"]+:[^\s/@'"]+@[^\s/'"]+""", "mask_basic_auth", 25, needs=("://",)),
    Rule("unc_network_path", "regex", "network_path", r"\\\\[\w.-]+(?:\\[\w.$ -]+)+", "mask_ag_yolu", 26, needs=("\\\\",)),
    Rule("email_address", "regex", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "mask_email", 30, needs=("@",)),
    Rule("ipv4_address", "regex", "ip", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b", "mask_ip", 40),
    Rule("uuid", "regex", "uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "mask_uuid", 45, "i"),
    Rule("tc_kimlik_no", "regex", "tc_kimlik_no", r"\b[1-9][0-9]{10}\b", "mask_tc_kimlik", 50, validator="tc_kimlik_no"),
    Rule("contextual_personnel_id", "regex", "personel_kimlik_no", r"\b(?:sicil(?:\s*(?:no|numaras[ıi]))?|personel\s*(?:no|numaras[ıi])|employee\s*id)\s*[:\-]?\s*[0-9]{5,8}\b(?:\s*(?:,|/|ve)\s*[0-9]{5,8}\b)*", "mask_personel_kimlik", 52, "i"),
    Rule("allow_rfc5737_192_0_2", "allow", "rfc5737_test_ip", r"\b192\.0\.2\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "mask_rfc5737_ip", 200, entity="RFC5737_TEST_IP", score=1.0, needs=("192.0.2.",)),
    Rule("allow_rfc5737_198_51_100", "allow", "rfc5737_test_ip", r"\b198\.51\.100\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "mask_rfc5737_ip", 201, entity="RFC5737_TEST_IP", score=1.0, needs=("198.51.100.",)),
    Rule("allow_rfc5737_203_0_113", "allow", "rfc5737_test_ip", r"\b203\.0\.113\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "mask_rfc5737_ip", 202, entity="RFC5737_TEST_IP", score=1.0, needs=("203.0.113.",)),
    Rule("allow_xmlns_namespace_uri", "allow", "xml_namespace_uri", r"""\bxmlns(?::[\w.-]+)?\s*=\s*(?:"https?://[^"]*"|'https?://[^']*')""", "mask_xml_ns", 203, "i", entity="XML_NAMESPACE_URI", score=1.0),
    Rule("presidio_dotenv_reference", "recogniser", "config_secret_reference", r"\.env\b", "mask_config_secret_ref", 210, "i", entity="CONFIG_SECRET_REFERENCE", score=0.95),
    Rule("presidio_yaml_secrets_reference", "recogniser", "config_secret_reference", r"\bsecrets?\.ya?ml\b", "mask_config_secret_ref", 211, "i", entity="CONFIG_SECRET_REFERENCE", score=0.95),
    Rule("presidio_properties_config_reference", "recogniser", "config_secret_reference", r"\bconfig(?:uration)?\.properties\b", "mask_config_secret_ref", 212, "i", entity="CONFIG_SECRET_REFERENCE", score=0.9),
    Rule("presidio_credentials_file_reference", "recogniser", "config_secret_reference", r"\bcredentials?\.(?:json|xml|ini)\b", "mask_config_secret_ref", 213, "i", entity="CONFIG_SECRET_REFERENCE", score=0.95),
    Rule("presidio_internal_domain_name", "recogniser", "internal_domain", r"\b(?:[\w-]+\.)+(?:internal|local)\b", "mask_ic_domain", 220, "i", entity="IC_DOMAIN_ADI", score=0.9),
    Rule("presidio_internal_prod_hostname", "recogniser", "internal_hostname", r"\b[\w\-]+-prod-[\w\-]+\b", "mask_ic_host", 221, "i", entity="IC_PROD_HOSTNAME", score=0.9),
)

#: Second-layer recognisers that need no language model, with their scores.
RECOGNISERS: tuple[Rule, ...] = (
    Rule("builtin_email", "recogniser", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "mask_email_address", 300, entity="EMAIL_ADDRESS", score=0.85, needs=("@",)),
    Rule("builtin_ip", "recogniser", "IP_ADDRESS", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", "mask_ip_address", 301, entity="IP_ADDRESS", score=0.85),
    Rule("builtin_card", "recogniser", "CREDIT_CARD", r"[0-9]{13,19}", "mask_credit_card", 302, validator="luhn", entity="CREDIT_CARD", score=0.75),
    Rule("builtin_iban", "recogniser", "IBAN_CODE", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "mask_iban_code", 303, validator="iban", entity="IBAN_CODE", score=0.85),
    Rule("builtin_phone", "recogniser", "PHONE_NUMBER", r"\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "mask_phone_number", 304, entity="PHONE_NUMBER", score=0.65, needs=(" (",)),
)

#: Placeholders: the current form, the older form, and bare numbers that stand for numbers in JSON.
PLACEHOLDER = r"mask_[a-z0-9_]+?_[0-9]+"
OLD_PLACEHOLDER = r"[A-Z][A-Z0-9_]*_TEST_[0-9]+"
JSON_NUMBER = r"811199[0-9]{9}|911199[0-9]{10}"

VALIDATORS: dict[str, Callable[[Column], Column]] = {"tc_kimlik_no": checks.national_id, "luhn": checks.luhn, "iban": checks.iban, "secret_value": checks.secret_value}

#: What joins a value to its neighbours, and the endings that may follow it.
_LOWER, _UPPER = "a-zçğıöşü", "A-ZÇĞİÖŞÜ"
_JOINED = f"0-9_{_LOWER}{_UPPER}"
_ENDINGS = (
    "dan", "den", "tan", "ten",
    "dır", "dir", "dur", "dür", "tır", "tir", "tur", "tür",
    "nın", "nin", "nun", "nün", "ın", "in", "un", "ün",
)


def parametric(value: str | None) -> str | None:
    """The pattern of a run-time value: whole, between word limits or case changes, or with an ending that ends the word; None without a value."""
    if not (value or "").strip():
        return None
    left = f"(?:(?<![{_JOINED}])|(?-i:(?<=[{_LOWER}])(?=[{_UPPER}])|(?<=[{_UPPER}])(?=[{_UPPER}][{_LOWER}])))"
    right = f"(?=$|[^{_JOINED}]|(?-i:(?<=[{_LOWER}])[{_UPPER}]|(?<=[{_UPPER}])[{_UPPER}][{_LOWER}])|(?:{'|'.join(_ENDINGS)})(?![{_JOINED}]))"
    return left + re.escape(value.strip()) + right


def bound(rules: tuple[Rule, ...] = RULES, values: dict[str, str] | None = None) -> list[Rule]:
    """Active rules in order of priority, run-time values put in; those without a value are left out, and unknown validators refused."""
    out = []
    for rule in sorted(rules, key=lambda r: (r.priority, r.name)):
        if not rule.active:
            continue
        if rule.validator and rule.validator not in VALIDATORS:
            raise ValueError(f"rule {rule.name}: no validator {rule.validator!r}")
        if rule.kind == "parametric":
            pattern = parametric((values or {}).get(rule.category))
            if pattern:
                out.append(replace(rule, pattern=pattern, flags="i"))
        elif rule.pattern:
            out.append(rule)
    return out


def register_rule(rules: tuple[Rule, ...], rule: Rule) -> tuple[Rule, ...]:
    """``rules`` with one more, or with the one of that name replaced.

    Its pattern must be a regular expression of Python, and of Java in the form
    that Spark will use, which an active session compiles here: what would stop a
    job is refused now.
    """
    if rule.pattern:
        re.compile(rule.pattern)
        spark = SparkSession.getActiveSession()
        if spark is not None and not rule.by_python:
            used = rule.narrowed[0] if rule.narrowed else rule.java
            try:
                spark.range(1).select(F.concat(F.lit("a"), F.col("id").cast("string")).rlike(used)).collect()
            except (PySparkException, Py4JJavaError) as e:
                raise ValueError(f"rule {rule.name}: Spark cannot use the pattern {used!r}") from e
    return (*(r for r in rules if r.name != rule.name), rule)


def register_validator(name: str, check: Callable[[Column], Column]) -> None:
    VALIDATORS[name] = check


def confidence(score: Column) -> Column:
    """high, medium or low, by their names in results."""
    return F.when(score >= 0.85, "yuksek").when(score >= 0.6, "orta").otherwise("dusuk")
