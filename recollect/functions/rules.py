"""Rules as data: what to extract, what to refuse, what to review.

Patterns are in Java's dialect.  A word boundary beside CJK text is spelled out, since Java
counts CJK letters as word characters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Shapes of secrets.
TOKEN_SHAPE = B + r"(?:sk|ghp|github_pat|xox[baprs]|hf|tp)-[A-Za-z0-9_\-]{16,}" + E
SECRET_VALUE = r"((?:password|passwd|密码|口令|token|api[_\s-]?key)[：:=\s]+)([^\s，。,'\"`]{6,})"

#: Phrases of instructions about the assistant itself, and signs that a turn is worth learning from.
META_MARKERS = ("review the conversation above", "update the skill library", "first-class skill signals", "not just memory signals", "update the relevant skill")
LEARN_MARKERS = ("记住", "不是", "不对", "应该", "以后", "不要", "别", "我喜欢", "我希望", "默认", "尽量", "就这样", "定了", "统一", "remember", "note ", "don't", "do not", "always", "default to", "instead of")


#: What a host puts into turns; tags that hold injected memories are the caller's to name.
REPLY_PREVIEW = r"^\s*\[Replying to:\s*[\"“][\s\S]*?[\"”]\]\s*"
SYSTEM_NOTE = r"(?is)\[System note:.*?\]\s*"
CONTEXT_TAGS = ("memory-context",)

#: Phrases that speak to the model, kinds of memories, prefixes of ids by layer.
INJECTION = r"(?i)ignore (?:all )?(?:previous|above) instructions?|disregard (?:all )?(?:previous|above) instructions?|system prompt|developer message|jailbreak|你现在是|忽略(?:之前|以上|上面).{0,10}指令"
MEMORY_KINDS = ("behavioral", "terminological", "procedural", "architectural")
STATUSES = ("candidate", "active", "fading", "dormant", "retired", "locked")
ID_PREFIXES = {"raw": "ENG", "observation": "OBS", "mental_model": "MM", "experience": "EXP"}

#: Headings of the injected text, its body without memories, words that mark a turn to keep before compression.
HEADINGS = ("### Directives (must follow)", "### Constraints", "### Consider")
NOTHING = "(no relevant memories)"
INSIGHT_MARKERS = ("记住", "不是", "以后", "我喜欢", "不要")


@dataclass(frozen=True)
class Extraction:
    """One rule: the first match in a text gives one candidate; {1} and {2} are its groups, cleaned if clean."""

    name: str
    pattern: str
    kind: str
    polarity: str | None
    statement: str = "{1}"
    domain: str = "general"
    tags: tuple[str, ...] = field(default=())
    confidence: int = 5
    clean: bool = True

    @property
    def hints(self) -> tuple[str, ...]:
        """Lower-case words one of which every match holds: a cheap look before the pattern's."""
        return HINTS[self.name]


#: Fixed values, in order: what each rule looks for and says.
EXTRACTIONS = (
    Extraction("secret_token", TOKEN_SHAPE, "procedural", "do", "用户配置了 API/token 类密钥；不得保存或复述原始密钥值。", "environment/secrets", ("secret", "redacted"), 8),
    Extraction("secret_value", "(?i)" + SECRET_VALUE, "procedural", "do", "用户配置了敏感凭据；不得保存或复述原始凭据值。", "environment/secrets", ("secret", "redacted"), 8),
    Extraction("port", r"(?i)(?:port|端口)(?:\s*(?:是|为|=|:|：|on|at))?\s*(\d{4,5})", "procedural", "do", "运行环境端口是 {1}。", "environment/runtime", ("port",), 7, False),
    Extraction("path", r"(?i)(?:代码|项目|仓库|repo|repository).{0,8}(?:放在|位于|路径是|path is|lives in)\s*([~./A-Za-z0-9_\-][^\s，。'\"]{2,})", "procedural", "do", "项目路径是 {1}。", "environment/path", ("path", "project"), 7, False),
    Extraction("url", r"(?i)(https?://[^\s，。'\"`]+(?:\.[^\s，。'\"`]*)?)", "procedural", "do", "相关 URL 是 {1}。", "environment/url", ("url",), 6, False),
    Extraction("project", r"(?i)([A-Za-z][\w-]{1,40})\s*(?:是|is)\s*(?:我的|my)\s*(记忆插件|插件|项目|repo|repository|仓库)", "architectural", "do", "{1} 是用户的{2}。", "project/facts", ("project",), 7, False),
    Extraction("when_then", r"(?i)(?:遇到|碰到|when)\s*(.{3,60}?)(?:就|要|should|then)\s*(.{3,80})", "procedural", "do", "遇到 {1} 时，应 {2}。", "knowledge/procedure", ("skill", "procedure"), 6),
    Extraction("right_way", r"(?i)(?:正确的做法是|正确做法是|the right way is)\s*(.{5,100})", "procedural", "do", "正确做法是 {1}。", "knowledge/procedure", ("skill", "procedure"), 7),
    Extraction("correction_is", r"不是[，,]\s*(.{8,})", "terminological", "dont"),
    Extraction("correction_right", r"不对[，,]\s*(.{8,})", "terminological", "dont"),
    Extraction("from_now_on", r"以后\s*(.{8,})", "behavioral", "do"),
    Extraction("remember_zh", r"记住[：:]\s*(.{8,})", "behavioral", None),
    Extraction("do_not_zh", r"不要\s*(.{8,})", "behavioral", "dont"),
    Extraction("use_not_zh", r"用\s*(\S+)\s*不用\s*(\S+)", "terminological", "do", "默认使用 {1}，不要使用 {2}。", "preferences/tools", ("tool-preference",), 5, False),
    Extraction("like", r"我喜欢\s*(.{8,})", "behavioral", "do"),
    Extraction("hope", r"我希望\s*(.{8,})", "behavioral", "do"),
    Extraction("default_zh", r"默认\s*(.{8,})", "behavioral", "do"),
    Extraction("try_to", r"尽量\s*(.{8,})", "behavioral", "do"),
    Extraction("avoid_zh", r"别\s*(.{8,})", "behavioral", "dont"),
    Extraction("decided_so", r"就这样[，,]?\s*(.{8,})", "architectural", "do"),
    Extraction("decided", r"定了[，,]?\s*(.{8,})", "architectural", "do"),
    Extraction("always_zh", r"以后都\s*(.{8,})", "behavioral", "do"),
    Extraction("unify", r"统一\s*(.{8,})", "architectural", "do"),
    Extraction("use_instead", r"(?i)(?:use|prefer)\s+(\S+)\s+(?:instead of|not)\s+(\S+)", "terminological", "do", "Default to {1} instead of {2}.", "preferences/tools", ("tool-preference",), 5, False),
    Extraction("do_not", r"(?i)(?:don't|do not)\s+(.{8,})", "behavioral", "dont"),
    Extraction("remember", r"(?i)(?:remember|note)\s+(?:that\s+)?(.{8,})", "behavioral", None),
    Extraction("always", r"(?i)(?:always|default to)\s+(.{8,})", "behavioral", "do"),
)

#: What each rule's matches can't do without.
HINTS = {
    "secret_token": ("sk-", "ghp-", "github_pat-", "xox", "hf-", "tp-"),
    "secret_value": ("password", "passwd", "密码", "口令", "token", "api"),
    "port": ("port", "端口"),
    "path": ("代码", "项目", "仓库", "repo"),
    "url": ("http",),
    "project": ("我的", "my"),
    "when_then": ("遇到", "碰到", "when"),
    "right_way": ("做法是", "the right way is"),
    "correction_is": ("不是",),
    "correction_right": ("不对",),
    "from_now_on": ("以后",),
    "remember_zh": ("记住",),
    "do_not_zh": ("不要",),
    "use_not_zh": ("不用",),
    "like": ("我喜欢",),
    "hope": ("我希望",),
    "default_zh": ("默认",),
    "try_to": ("尽量",),
    "avoid_zh": ("别",),
    "decided_so": ("就这样",),
    "decided": ("定了",),
    "always_zh": ("以后都",),
    "unify": ("统一",),
    "use_instead": ("instead of", "not"),
    "do_not": ("don't", "do not"),
    "remember": ("remember", "note"),
    "always": ("always", "default to"),
}

#: Review rules.
TEST_TAGS = ("dogfood", "test", "testing", "smoke", "benchmark", "debug")
TEST_DOMAINS = ("test", "testing", "benchmark", "dogfood")
TEST_SOURCE = r"(?i)test|benchmark|dogfood"
TEST_MARKERS = rf"(?i){B}marker{E}|dogfood|smoke|cli-explain|telegram-live|hermes-provider-v?\d+|{B}[a-z]+(?:-[a-z0-9]+){{2,}}-\d{{8,}}"
ENGINEERING = rf"(?i:{B}benchmark{E}|{B}persistence{E}|{B}mutate{E}|{B}iterations?{E}|{B}counts?{E}|{B}\d+K(?:/\d+K)+{E})|{B}NaN{E}"
CONVERSATIONAL = r"^别的账号呢[？?]?$|^不是已经.+[？?]?$|^不是能自动获取吗[？?]?$|^应该.+是什么意思[？?]?$"
MALFORMED = r"记住：.*\"\s+\"好的[）)]?\"?$|默认端口是\s*7897\"\s+\"好的[）)]?\"?$|怎么还记住这个[？?]?$"

#: Fixed values, in order: words that tell the kind of a repeated pattern.
PATTERN_KINDS = (
    ("preference", "prefer|prefers|喜欢|偏好|希望|expects|wants"),
    ("workflow", "workflow|process|step|procedure|debugging|diagnosis|evidence-first|流程|步骤|pipeline"),
    ("cause_effect", "because|cause|导致|由于|therefore|so "),
    ("correlation", "correlat|related|关联|相关"),
)
#: How far strength fades in a day, by layer, and weights of the ranking's nine sides.
FADING = {"mental_model": 0.01, "observation": 0.025, "raw": 0.05, "experience": 0.08}
RANK_WEIGHTS = {"relevance": 0.22, "specificity": 0.08, "activation": 0.12, "recency": 0.12, "evidence": 0.08, "confidence": 0.08, "scope": 0.08, "polarity": 0.04, "quality": 0.18}
BUDGET_SHARES = {"mental_model": 0.40, "observation": 0.35, "raw": 0.20, "experience": 0.05}
