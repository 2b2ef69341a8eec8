"""Personal data, secrets, prompt injection and access rules, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values that results depend on.
PII_PATTERNS = (
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("db_dsn", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)(?:\+\w+)?://[^\s:@/]+:[^\s@]+@[^\s/]+(?:/\S*)?"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b"),
    ("api_key", r"\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})\b"),
    ("cn_id_card", r"(?<!\d)(?:[1-9]\d{5})(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"),
    ("bank_card", r"(?<!\d)(?:4\d{15}|5[1-5]\d{14}|62\d{14,17}|3[47]\d{13})(?!\d)"),
    ("cn_mobile", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])"),
)
SECRET_TYPES = ("private_key", "db_dsn", "jwt", "api_key")
PII_SEVERITY = {"email": 1, "ipv4": 1, "cn_mobile": 2, "cn_id_card": 3, "bank_card": 3, "jwt": 3, "api_key": 3, "db_dsn": 3, "private_key": 3}
INJECTION_PATTERNS = (
    (r"ignore\s+(?:all|previous|prior|above)\s+(?:instructions?|prompts?|rules?)", "instruction_override"),
    (r"disregard\s+(?:all|previous|prior|above)", "instruction_override"),
    (r"forget\s+(?:all|previous|prior|your)\s+(?:instructions?|rules?|context)", "instruction_override"),
    (r"忽略(?:之前|先前|上述|所有|全部).{0,5}(?:指令|指示|规则|说明|提示)", "instruction_override"),
    (r"you\s+are\s+now\s+(?:a|an|the)\s+\w+", "role_impersonation"),
    (r"从现在起你是[^\s]+", "role_impersonation"),
    (r"现在你是[^\s]+", "role_impersonation"),
    (r"your\s+new\s+(?:role|persona|identity)\s+is", "role_impersonation"),
    (r"(?:show|print|reveal|output)\s+(?:your|the)\s+(?:system|initial|hidden|original)\s+prompt", "prompt_leak"),
    (r"(?:显示|打印|输出|泄露)\s+(?:系统|初始|隐藏)\s*(?:提示|prompt|指令)", "prompt_leak"),
    (r"\bDAN\s+mode\b", "jailbreak_marker"),
    (r"developer\s+mode\s+(?:enabled|on|activated)", "jailbreak_marker"),
    (r"(?:do anything now|无限制模式|解除限制)", "jailbreak_marker"),
    (r"</?(?:system|assistant|user|instruction|prompt)\s*>", "tag_injection"),
    (r"<\|(?:im_start|im_end|system|endoftext)\|>", "special_token"),
    (r"(?:show|list|dump)\s+(?:all|every)\s+(?:emails?|passwords?|secrets?|tokens?|api\s*keys?)", "data_exfil"),
    (r"(?:泄露|打印|给我)\s*(?:所有|全部)\s*(?:密码|密钥|token|api)", "data_exfil"),
)
OUTPUT_INJECTION_PATTERNS = (
    (r"<system>|<assistant>|<\|im_start\|>", "tag_in_output"),
    (r"(?:here\s+is\s+(?:the|your)\s+system\s+prompt)", "leaked_system_marker"),
    (r"(?:system\s+prompt\s*[:：])", "leaked_system_marker"),
    (r"^\s*I\s+am\s+now\s+(?:a|an)\s+", "impersonation_in_output"),
)
DENIED_PATHS = (".env", "/.ssh/", "/secrets/", "/etc/", "../")
ABSTAIN_PHRASES = ("我无法在知识库中找到", "无法在知识库中找到", "I cannot find", "no information")
TRANSFER_TRIGGERS = ("人工", "投诉", "经理", "客服", "退款不到", "紧急")
INTENT_KEYWORDS = {
    "billing": ("发票", "支付", "充值", "扣款", "invoice", "pay", "billing"),
    "technical": ("闪退", "登录失败", "崩溃", "crash", "bug", "技术"),
    "account": ("密码", "账号", "登录", "注册", "注销", "account", "password"),
    "refund": ("退款", "退订", "退货", "refund"),
    "shipping": ("快递", "物流", "发货", "收货", "shipping", "delivery"),
    "general": ("咨询", "活动", "优惠券", "会员", "general"),
}
TENANT_PATTERN = r"^[a-z0-9][a-z0-9-]{1,30}[a-z0-9]$"
USER_PATTERN = r"^[A-Za-z0-9._-]{1,64}$"


def mask_pii(value: Column, kind: Column) -> Column:
    """Partly hidden: an address keeps its first letter and domain, long numbers their ends."""
    name, domain = F.substring_index(value, "@", 1), F.regexp_replace(value, r"^[^@]*@", "")
    n = F.char_length(value)
    return (
        F.when((kind == "email") & F.contains(value, F.lit("@")), F.concat(F.substring(name, 1, 1), F.repeat(F.lit("*"), F.greatest(F.char_length(name) - 1, F.lit(3))), F.lit("@"), domain))
        .when(kind.isin("cn_mobile", "bank_card", "cn_id_card") & (n > 7), F.concat(F.substring(value, 1, 3), F.repeat(F.lit("*"), n - 7), F.substring(value, -4, 4)))
        .otherwise(F.repeat(F.lit("*"), n))
    )


def drop_pii(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Hits replaced by <TYPE>, rule by rule; exact where rules don't overlap (see functions.python for positions)."""
    for kind, pattern in PII_PATTERNS:
        if kinds is None or kind in kinds:
            text = F.regexp_replace(text, pattern, f"<{kind.upper()}>")
    return text


def sensitivity_after(declared: Column, kinds: Column) -> Column:
    """The declared level 1-3 raised to the severity of the hits, never lowered."""
    worst = F.array_max(F.transform(kinds, lambda k: F.coalesce(F.create_map(*[F.lit(x) for kv in PII_SEVERITY.items() for x in kv])[k], F.lit(0))))
    return F.greatest(declared, F.coalesce(worst, F.lit(0)))


def injection_kinds(text: Column) -> Column:
    """Distinct kinds of injection attempts found, in the rules' order."""
    found = [F.when(text.rlike(f"(?i){p}"), F.lit(kind)) for p, kind in INJECTION_PATTERNS]
    return F.array_compact(F.array_distinct(F.array(*found)))


def is_injection(text: Column, least_kinds: int = 2) -> Column:
    return F.size(injection_kinds(text)) >= least_kinds


def output_injections(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(kind)) for p, kind in OUTPUT_INJECTION_PATTERNS]))


def path_allowed(path: Column, roots: tuple[str, ...] = ()) -> Column:
    denied = F.lit(False)
    for part in DENIED_PATHS:
        denied = denied | F.contains(path, F.lit(part))
    inside = F.lit(not roots)
    for root in roots:
        inside = inside | path.startswith(root)
    return ~denied & inside


def safe_uri(path: Column) -> Column:
    """Percent-encoded relative path; null for absolute, climbing or injected ones."""
    bad = path.startswith("/") | path.startswith("~") | F.array_contains(F.split(path, "/"), "..") | path.rlike(r"[\x00-\x1f;|`$<>\\]")
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.when(~bad, F.array_join(parts, "/"))


def tenant_id_valid(tenant: Column) -> Column:
    return tenant.rlike(TENANT_PATTERN) & ~F.contains(tenant, F.lit("--"))


def user_id_valid(user: Column) -> Column:
    return user.rlike(USER_PATTERN)


def needs_transfer(text: Column) -> Column:
    return text.rlike("|".join(TRANSFER_TRIGGERS))


def intent(text: Column) -> Column:
    """struct(intent, confidence): most keyword hits, the earlier intent on ties, general at 0.2 without any."""
    low = F.lower(text)
    scores = F.array(*[sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)) for words in INTENT_KEYWORDS.values()])
    best = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0), lambda a, x: a + x)
    name = F.element_at(F.array(*[F.lit(k) for k in INTENT_KEYWORDS]), F.array_position(scores, best).cast("int"))
    return F.struct(F.when(best == 0, "general").otherwise(name).alias("intent"), F.when(best == 0, 0.2).otherwise(best / total).alias("confidence"))


def parse_answer(raw: Column) -> Column:
    """struct(answer, citations, abstained, parsed) of a model's reply: its JSON object, else the text itself."""
    got = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "answer string, citations array<string>, abstained boolean", {"mode": "PERMISSIVE"})
    parsed = got.isNotNull() & got["answer"].isNotNull()
    head = F.substring(F.trim(raw), 1, 30)
    phrase = F.lit(False)
    for p in ABSTAIN_PHRASES:
        phrase = phrase | F.contains(head, F.lit(p))
    return F.struct(
        F.when(parsed, got["answer"]).otherwise(raw).alias("answer"),
        F.when(parsed, F.coalesce(got["citations"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.when(parsed, F.coalesce(got["abstained"], F.lit(False))).otherwise(phrase).alias("abstained"),
        parsed.alias("parsed"),
    )


def output_verdict(raw: Column, allowed: Column) -> Column:
    """ok, or why a reply must be turned into an abstention."""
    got = parse_answer(raw)
    return (
        F.when(~got["parsed"], "not_json")
        .when(F.size(output_injections(got["answer"])) > 0, "injection_marker_in_output")
        .when(F.size(F.array_except(got["citations"], allowed)) > 0, "citations_invalid")
        .otherwise("ok")
    )
