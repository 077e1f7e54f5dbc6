"""Rule scans of source lines, dependency audits with semantic versions, and route detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.literals import required
from tessera.functions.paths import glob_to_regex, redact
from tessera.operators.textsearch import lines

SEVERITIES = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

#: Rules of our own as (id, category, severity, pattern, files, files left out). Patterns keep to syntax that Java and RE2 share.
RULES = [
    ("SEC-001", "secrets", "CRITICAL", r"(?i)(?:password|passwd|pwd)\s*[:=]\s*['\"][^'\"]{4,}['\"]", "**", "**/*.test.*"),
    ("SEC-002", "secrets", "CRITICAL", r"(?i)(?:secret|secret_?key|client_?secret|signing_?key)\s*[:=]\s*['\"][A-Za-z0-9_+=/-]{16,}['\"]", "**", "**/*.test.*"),
    ("SEC-003", "secrets", "CRITICAL", r"(?i)(?:api_?key|token)\s*[:=]\s*['\"][A-Za-z0-9_-]{16,}['\"]", "**", "**/*.test.*"),
    ("SEC-004", "secrets", "CRITICAL", r"\bAKIA[0-9A-Z]{16}\b", "**", ""),
    ("SEC-005", "secrets", "CRITICAL", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "**", ""),
    ("SEC-006", "secrets", "CRITICAL", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", "**", ""),
    ("INJ-001", "injection", "CRITICAL", r"(?i)\b(?:query|execute|exec)\s*\(\s*['\"`].*(?:select|insert|update|delete)\b.*['\"`]\s*\+", "**", ""),
    ("INJ-002", "injection", "HIGH", r"(?i)f['\"](?:select|insert|update|delete)\b.*\{", "**/*.py", ""),
    ("RCE-001", "rce", "CRITICAL", r"\beval\s*\(", "**", ""),
    ("RCE-002", "rce", "HIGH", r"\bos\.system\s*\(|subprocess\.\w+\(.*shell\s*=\s*True", "**/*.py", ""),
    ("XSS-001", "xss", "HIGH", r"\.innerHTML\s*=|dangerouslySetInnerHTML|document\.write\s*\(", "**", ""),
    ("DES-001", "deserialization", "HIGH", r"\bpickle\.loads?\s*\(|\byaml\.load\s*\(", "**/*.py", ""),
    ("CRY-001", "crypto", "MEDIUM", r"(?i)\b(?:md5|sha1)\s*\(", "**", ""),
    ("CRY-002", "crypto", "MEDIUM", r"\bMath\.random\s*\(", "**/*.{ts,js,vue}", ""),
    ("NET-001", "config", "MEDIUM", r"(?i)verify\s*=\s*False|rejectUnauthorized\s*:\s*false", "**", ""),
    ("NET-002", "cors-headers", "MEDIUM", r"Access-Control-Allow-Origin['\"]?\s*[:,]\s*['\"]\*['\"]", "**", ""),
    ("PII-001", "data-leak", "LOW", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "**", ""),
    ("PII-002", "data-leak", "LOW", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "**", ""),
    ("DOC-001", "docker", "MEDIUM", r"^FROM\s+\S+:latest\b", "**/Dockerfile*", ""),
    ("SEC-007", "secrets", "CRITICAL", r"\bxox[abprs]-[0-9A-Za-z-]{10,}", "**", ""),
    ("SEC-008", "secrets", "CRITICAL", r"\bsk_live_[0-9A-Za-z]{16,}", "**", ""),
    ("SEC-009", "secrets", "CRITICAL", r"\bAIza[0-9A-Za-z_-]{35}", "**", ""),
    ("SEC-010", "secrets", "CRITICAL", r"\bglpat-[0-9A-Za-z_-]{20}", "**", ""),
    ("SEC-011", "secrets", "HIGH", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "**", "**/*.test.*"),
    ("SEC-012", "secrets", "HIGH", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:[^\s:/@]+@", "**", "**/*.{md,example}"),
    ("SEC-013", "secrets", "HIGH", r"(?i)\bauthorization['\"]?\s*[:=]\s*['\"](?:basic|bearer)\s+[A-Za-z0-9+/=._-]{12,}", "**", "**/*.test.*"),
    ("SEC-014", "secrets", "HIGH", r"\bSG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}", "**", ""),
    ("SEC-015", "secrets", "HIGH", r"\bnpm_[A-Za-z0-9]{36}\b", "**", ""),
    ("SEC-016", "secrets", "MEDIUM", r"(?i)\b(?:aws_secret_access_key|azure_client_secret|private_key)\b\s*[:=]\s*\S{16,}", "**", ""),
    ("INJ-003", "injection", "CRITICAL", r"(?i)`\s*(?:select|insert into|update|delete from)\b[^`]*\$\{", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("INJ-004", "injection", "HIGH", r"(?i)['\"](?:select|insert|update|delete)\b[^'\"]*['\"]\s*%\s*[\w(]", "**/*.py", ""),
    ("INJ-005", "injection", "HIGH", r"(?i)\.(?:raw|extra|execute)\s*\(\s*f['\"]", "**/*.py", ""),
    ("INJ-006", "injection", "HIGH", r"(?i)fmt\.Sprintf\s*\(\s*['\"`](?:select|insert|update|delete)\b", "**/*.go", ""),
    ("INJ-007", "injection", "HIGH", r"(?i)(?:createQuery|executeQuery|prepareStatement)\s*\(\s*\"[^\"]*\"\s*\+", "**/*.java", ""),
    ("INJ-008", "injection", "HIGH", r"(?i)mysqli?_query\s*\([^)]*\$_(?:get|post|request)", "**/*.php", ""),
    ("INJ-009", "injection", "HIGH", r"(?i)\bwhere\s*\(\s*\"[^\"]*#\{", "**/*.rb", ""),
    ("INJ-010", "injection", "HIGH", r"\$where['\"]?\s*:", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("INJ-011", "injection", "MEDIUM", r"(?i)\b(?:ldap|xpath)\w*\.(?:search|evaluate|select)\s*\([^)]*\+", "**", ""),
    ("RCE-003", "rce", "CRITICAL", r"\bnew\s+Function\s*\(", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("RCE-004", "rce", "CRITICAL", r"\b(?:exec|execSync|spawn)\s*\(\s*(?:`[^`]*\$\{|['\"][^'\"]*['\"]\s*\+)", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("RCE-005", "rce", "HIGH", r"(?i)\b(?:shell_exec|passthru|popen|proc_open|system)\s*\(\s*\$", "**/*.php", ""),
    ("RCE-006", "rce", "HIGH", r"Runtime\.getRuntime\(\)\.exec\s*\(", "**/*.java", ""),
    ("RCE-007", "rce", "HIGH", r"exec\.Command\s*\(\s*\"(?:sh|bash|cmd)\"", "**/*.go", ""),
    ("RCE-008", "rce", "HIGH", r"(?:\b(?:instance_eval|class_eval|send)\s*\(?\s*params|`[^`]*#\{)", "**/*.rb", ""),
    ("RCE-009", "rce", "HIGH", r"\b(?:vm|vm2)\.(?:runInNewContext|runInThisContext)\s*\(", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("RCE-010", "rce", "HIGH", r"\b__import__\s*\(|\bexec\s*\(\s*(?:request|input|data)", "**/*.py", ""),
    ("XSS-002", "xss", "HIGH", r"\bv-html\s*=|\{\{\{[^}]*\}\}\}", "**/*.{vue,html,hbs}", ""),
    ("XSS-003", "xss", "HIGH", r"\b(?:outerHTML|insertAdjacentHTML)\b\s*[=(]", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("XSS-004", "xss", "HIGH", r"\|\s*safe\b|mark_safe\s*\(|autoescape\s+off", "**/*.{py,html,jinja}", ""),
    ("XSS-005", "xss", "HIGH", r"(?i)\becho\s+\$_(?:get|post|request|cookie)", "**/*.php", ""),
    ("XSS-006", "xss", "MEDIUM", r"\braw\s*\(|\.html_safe\b", "**/*.{rb,erb}", ""),
    ("XSS-007", "xss", "MEDIUM", r"\bbypassSecurityTrust\w+\s*\(", "**/*.ts", ""),
    ("XSS-008", "xss", "MEDIUM", r"(?i)href\s*=\s*['\"]\s*javascript:", "**", ""),
    ("PTH-001", "path-traversal", "HIGH", r"\b(?:readFile|readFileSync|createReadStream|sendFile)\s*\([^)]*req\.(?:params|query|body)", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("PTH-002", "path-traversal", "HIGH", r"\bopen\s*\(\s*(?:request|flask\.request)\.", "**/*.py", ""),
    ("PTH-003", "path-traversal", "HIGH", r"(?i)\b(?:include|require)(?:_once)?\s*\(?\s*\$_(?:get|post|request)", "**/*.php", ""),
    ("PTH-004", "path-traversal", "MEDIUM", r"\.\./\.\./\.\./", "**/*.{py,go,java,php,rb}", "**/*test*"),
    ("DES-002", "deserialization", "HIGH", r"\bunserialize\s*\(\s*\$", "**/*.php", ""),
    ("DES-003", "deserialization", "HIGH", r"\bnew\s+ObjectInputStream\s*\(|\breadObject\s*\(\s*\)", "**/*.java", ""),
    ("DES-004", "deserialization", "HIGH", r"\b(?:Marshal|YAML)\.load\s*\(", "**/*.rb", ""),
    ("DES-005", "deserialization", "MEDIUM", r"\b(?:shelve\.open|marshal\.loads?|dill\.loads?|jsonpickle\.decode)\s*\(", "**/*.py", ""),
    ("CRY-003", "crypto", "HIGH", r"(?i)\b(?:des|rc4|rc2|blowfish)\b.{0,12}\b(?:cipher|encrypt|createcipher)|createCipher\s*\(", "**", ""),
    ("CRY-004", "crypto", "HIGH", r"(?i)\bAES[./_]ECB\b|MODE_ECB", "**", ""),
    ("CRY-005", "crypto", "MEDIUM", r"\brandom\.(?:random|randint|choice)\s*\(", "**/*.py", "**/*test*"),
    ("CRY-006", "crypto", "MEDIUM", r"\bmath/rand\b", "**/*.go", "**/*_test.go"),
    ("CRY-007", "crypto", "MEDIUM", r"\bnew\s+Random\s*\(", "**/*.java", ""),
    ("NET-003", "config", "HIGH", r"InsecureSkipVerify\s*:\s*true", "**/*.go", ""),
    ("NET-004", "config", "MEDIUM", r"NODE_TLS_REJECT_UNAUTHORIZED['\"]?\]?\s*[:=]\s*['\"]?0", "**", ""),
    ("NET-005", "config", "MEDIUM", r"\bDEBUG\s*=\s*True\b|\bapp\.run\([^)]*debug\s*=\s*True", "**/*.py", ""),
    ("NET-006", "config", "LOW", r"\bhttp://[A-Za-z0-9.-]+\.[a-z]{2,}", "**/*.{yml,yaml,toml,env}", ""),
    ("NET-007", "cors-headers", "MEDIUM", r"\bcors\s*\(\s*\)|origin\s*:\s*(?:true|['\"]\*['\"])", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("NET-008", "cors-headers", "LOW", r"(?i)x-powered-by|helmet\s*\(\s*\{[^}]*false", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("SRF-001", "ssrf", "HIGH", r"\b(?:axios|fetch|got|request)(?:\.\w+)?\s*\(\s*req\.(?:query|body|params)", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("SRF-002", "ssrf", "HIGH", r"\b(?:requests|httpx|urllib\.request)\.\w+\s*\(\s*request\.", "**/*.py", ""),
    ("SRF-003", "ssrf", "MEDIUM", r"\b169\.254\.169\.254\b", "**", ""),
    ("RED-001", "redirect", "MEDIUM", r"\bredirect\s*\(\s*(?:req|request)\.(?:query|params|args|GET)", "**", ""),
    ("COK-001", "session", "MEDIUM", r"(?i)\b(?:httpOnly|secure)\s*:\s*false\b", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("COK-002", "session", "MEDIUM", r"SESSION_COOKIE_SECURE\s*=\s*False|CSRF_COOKIE_SECURE\s*=\s*False|@csrf_exempt", "**/*.py", ""),
    ("COK-003", "session", "LOW", r"\blocalStorage\.setItem\s*\(\s*['\"][^'\"]*(?:token|jwt|password)", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("JWT-002", "jwt", "HIGH", r"\bjwt\.decode\s*\([^)]*verify(?:_signature)?['\"]?\s*[:=]\s*(?:False|false)", "**", ""),
    ("PRT-001", "prototype", "MEDIUM", r"__proto__['\"]?\]?\s*[=:]|\bconstructor\.prototype\b\s*=", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("RGX-001", "redos", "MEDIUM", r"new\s+RegExp\s*\(\s*(?:req|request|input|params)", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("XXE-001", "xxe", "HIGH", r"(?i)<!ENTITY\s+\S+\s+SYSTEM", "**", ""),
    ("XXE-002", "xxe", "MEDIUM", r"DocumentBuilderFactory\.newInstance\(\)|resolve_entities\s*=\s*True", "**/*.{java,py}", ""),
    ("DOC-002", "docker", "LOW", r"(?i)^ADD\s+https?://", "**/Dockerfile*", ""),
    ("DOC-003", "docker", "MEDIUM", r"(?i)^USER\s+root\b", "**/Dockerfile*", ""),
    ("DOC-004", "docker", "HIGH", r"(?i)^ENV\s+\w*(?:password|secret|token)\w*[= ]\S+", "**/Dockerfile*", ""),
    ("DOC-005", "docker", "HIGH", r"privileged\s*:\s*true", "**/*.{yml,yaml}", ""),
    ("CIC-001", "ci", "HIGH", r"\$\{\{\s*github\.event\.(?:issue|pull_request|comment)\.(?:title|body)", "**/*.{yml,yaml}", ""),
    ("CIC-002", "ci", "MEDIUM", r"\bcurl\b[^|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b", "**", ""),
    ("MEM-001", "memory", "HIGH", r"\b(?:strcpy|strcat|sprintf|gets)\s*\(", "**/*.{c,cc,cpp,h}", ""),
    ("MEM-002", "memory", "MEDIUM", r"\bunsafe\s*\{|\bmem::transmute\b", "**/*.rs", ""),
    ("UPL-001", "upload", "MEDIUM", r"\bmulter\s*\(\s*\)|move_uploaded_file\s*\(", "**", ""),
    ("PII-003", "data-leak", "MEDIUM", r"\bconsole\.log\s*\([^)]*(?:password|token|secret)", "**/*.{ts,tsx,js,jsx,mjs,cjs,vue}", ""),
    ("PII-004", "data-leak", "MEDIUM", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "**", ""),
    ("PII-005", "data-leak", "LOW", r"\b(?:4[0-9]{3}|5[1-5][0-9]{2})(?:[ -]?[0-9]{4}){3}\b", "**", ""),
    ("JWT-001", "jwt", "HIGH", r"(?i)algorithms?\s*[:=]\s*\[?\s*['\"]none['\"]", "**", ""),
]


def in_template(found: Column) -> Column:
    """Whether what was found in body stands in an event or a bound attribute of a template, or goes on a hyphenated name."""
    before = F.call_function("substring_index", F.col("body"), found, F.lit(1))
    return before.contains("@") | before.contains("v-on:") | before.rlike(r"(^|\s):(\w+-)*$|(^|\s):(\w+-)*password") | before.endswith("-")


def _once(column: Column) -> Column:
    """column, which a filter on it reads from the row: filters are not pushed below what numbers rows, so it is not worked out again for them."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def scan(files: DataFrame, rules: list[tuple] = RULES, apart: bool = True, every: bool = False, globs: bool = True, most_bytes: int | None = None) -> DataFrame:
    """(rule, category, severity, file, line, match): what rules find on lines of files (path, text), one row a rule and line.

    A file must fit a rule's globs and none of its exclusions (unless globs is False) and have at most most_bytes. apart drops
    all but the first rule of a category on a line; every gives all matches of a rule on a line, not the first alone. Matches
    of secrets are redacted, others cut to 100 characters. Null texts have no lines.

    Few rules concern a text. Each has literals of which every match holds one; a text is searched for them once (or, if a
    rule has none, by its pattern), and only texts with a rule left are cut into lines, on which only the rules left are
    tried, and those only where a line holds their literals. Nothing is joined or shuffled.
    """
    rules = sorted(rules, key=lambda r: r[0])
    wanted = sorted({(r[4], r[5]) for r in rules})
    within = [required(r[3]) for r in rules]

    def fits(glob: str, without: str) -> Column:
        path = lambda g: F.concat(F.lit("/"), F.col("path")) if g.startswith("**/") else F.col("path")  # noqa: E731  files of the root lie in a folder too
        yes = F.lit(True) if glob == "**" or not globs else path(glob).rlike(glob_to_regex(glob))
        return yes & ~path(without).rlike(glob_to_regex(without)) if without and globs else yes

    def holds(low: Column, words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(F.lit(w)) for w in words])

    def may(i: int) -> Column:
        """Whether a text may hold a match; a pattern over the whole text finds what it finds on a line, and more."""
        id_, _, _, pattern, glob, without = rules[i]
        here = holds(F.col("low"), within[i]) if within[i] else F.col("text").rlike(pattern if "^" not in pattern else "(?m)" + pattern)
        return F.when(F.col("fits")[wanted.index((glob, without))], here).otherwise(False)

    def answer(i: int) -> Column:
        id_, category, severity, pattern, *_ = rules[i]
        found = F.regexp_extract_all("body", F.lit(pattern), F.lit(0)) if every else F.array(F.regexp_substr("body", F.lit(pattern)))
        if id_ == "SEC-001":  # in a component's template the name of an event or a bound attribute is no secret
            found = F.filter(found, lambda x: ~(F.col("path").endswith(".vue") & in_template(x)))
        asked = F.col("left")[i] & (holds(F.col("low_body"), within[i]) if within[i] else F.lit(True))
        return F.when(asked, F.struct(F.lit(id_).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.filter(found, lambda x: x.isNotNull()).alias("found")))

    # globs and literals are tried once a file; a file that no rule is about is not read on
    asked = files.select("path", F.array(*[fits(*w) for w in wanted]).alias("fits"), "text").filter(F.exists("fits", lambda x: x))
    if most_bytes is not None:
        asked = asked.filter(F.octet_length("text") <= most_bytes)
    asked = asked.withColumn("low", F.lower("text"))
    asked = asked.select("path", "text", _once(F.array(*[may(i) for i in range(len(rules))])).alias("left")).filter(F.exists("left", lambda x: x))
    answers = F.filter(F.array(*[answer(i) for i in range(len(rules))]), lambda x: x.isNotNull() & (F.size(x["found"]) > 0))
    hits = lines(asked).withColumn("low_body", F.lower("body")).select(F.col("path").alias("file"), "line", _once(answers).alias("hits")).filter(F.size("hits") > 0)
    if apart:
        earlier = lambda x, i: F.exists(F.slice("hits", F.lit(1), i), lambda y: y["category"] == x["category"])
        hits = hits.withColumn("hits", F.filter("hits", lambda x, i: (i == 0) | ~earlier(x, i)))
    h, found = F.col("h"), F.col("found")
    cut_off = F.when(F.length(found) > 100, F.concat(F.substring(found, 1, 97), F.lit("..."))).otherwise(found)
    each = hits.withColumn("h", F.explode("hits")).withColumn("found", F.explode("h.found"))
    return each.select("h.rule", "h.category", "h.severity", "file", "line", F.when(h["category"] == "secrets", redact(found)).otherwise(cut_off).alias("match"))


def by_severity(findings: DataFrame, most: int = 50) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[F.col("severity")]
    return findings.orderBy(F.desc(rank), "file", "line", "rule").limit(most)


def score(findings: DataFrame) -> DataFrame:
    """One row: findings of each severity, and 100 less 5, 2 and half a point for each critical, high and medium one, at least 0."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    return n.withColumn("score", F.greatest(F.lit(0).cast("long"), F.floor(100 - 5 * F.col("critical") - 2 * F.col("high") - 0.5 * F.col("medium") + 0.5)))


SEMVER = r"^([0-9]+)\.([0-9]+)\.([0-9]+)((?:-[A-Za-z0-9_.-]+)?(?:\+[A-Za-z0-9_.-]+)?)$"


def semver(text: Column) -> Column:
    """struct(major, minor, patch, final, pre), ordered as versions are; null unless there are three numbers. Leading operators are dropped."""
    v = F.regexp_replace(F.trim(text), r"^[~^=<>]*", "")
    n = lambda i: F.regexp_extract(v, SEMVER, i).cast("long")
    pre = F.regexp_extract(v, SEMVER, 4)
    return F.when(v.rlike(SEMVER), F.struct(n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch"), (pre == "").alias("final"), pre.alias("pre")))


def in_range(version: Column, clause: Column) -> Column:
    """Whether a version is in a clause of one or two bounds ("< 2.0.0", ">= 1.0.0 < 1.2.3"). A bound that is no version makes it false."""
    v = semver(version)
    op = r"(>=|>|<=|<|==|=)\s+(\S+)"
    low_op, low = F.regexp_extract(clause, r"(>=|>)\s+(\S+)", 1), F.regexp_extract(clause, r"(>=|>)\s+(\S+)", 2)
    high_op, high = F.regexp_extract(clause, r"(<=|<|==|=)\s+(\S+)\s*$", 1), F.regexp_extract(clause, r"(<=|<|==|=)\s+(\S+)\s*$", 2)
    l, h = semver(low), semver(high)
    above = F.when(low_op == "", True).when(low_op == ">=", v >= l).otherwise(v > l)
    under = F.when(high_op == "", True).when(high_op == "<", v < h).when(high_op == "<=", v <= h).otherwise(v == h)
    return F.coalesce(clause.rlike(op) & v.isNotNull() & above & under, F.lit(False))


def audit(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """(id, package, version, severity): advisories (id, package, affected, severity) that hit dependencies (name, version, ecosystem), once each.

    Names match without regard to case. An empty or * version is hit by every advisory of its package; affected may have
    several clauses with || between.
    """
    a = advisories.select("id", "severity", F.lower("package").alias("package"), F.explode(F.split("affected", r"\s*\|\|\s*")).alias("clause"))
    d = dependencies.select(F.lower("name").alias("package"), "version")
    open_ = F.col("version").isNull() | F.col("version").isin("", "*")
    hit = d.join(a, "package").filter(open_ | in_range(F.col("version"), F.col("clause")))
    return hit.groupBy("id", "severity", "package").agg(F.min("version").alias("version"))


# How frameworks declare routes, as (framework, pattern, group of the method, group of the path, files).
ROUTES = [
    ("express", r"\b(?:app|router)\.(get|post|put|patch|delete|use|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, 2, "**/*.{ts,js,mjs,cjs}"),
    ("fastapi", r"@(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, "**/*.py"),
    ("flask", r"@(?:app|bp|blueprint)\.(route)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, "**/*.py"),
    ("nestjs", r"@(Get|Post|Put|Patch|Delete)\s*\(\s*['\"]?([^'\")]*)['\"]?\s*\)", 1, 2, "**/*.ts"),
    ("nestjs-gateway", r"@(SubscribeMessage)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1, 2, "**/*.ts"),
    ("go", r"\b(?:mux|router|http)\.(HandleFunc|Handle|Get|Post|Put|Delete)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, "**/*.go"),
    ("php", r"Route::(get|post|put|patch|delete|any)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, "**/*.php"),
    ("rails", r"\b(get|post|put|patch|delete|resources?|root)\s+['\"]([^'\"]+)['\"]", 1, 2, "**/*.rb"),
]


def outside_docstrings(rows: DataFrame) -> DataFrame:
    """Lines (path, line, body) that no docstring spans: an even number of triple quotes stand before them."""
    marks = F.size(F.split("body", "\"\"\"|'''")) - 1
    before = F.sum(marks).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("quotes", F.coalesce(before, F.lit(0))).filter("quotes % 2 = 0").drop("quotes")


def routes(files: DataFrame, patterns: list[tuple] = ROUTES) -> DataFrame:
    """(framework, method, route, path, line) of files (path, text), without those in Python docstrings."""
    rows = lines(files.select("path", "text"))
    python = F.col("path").rlike(r"(?i)\.py$")
    rows = outside_docstrings(rows.filter(python)).unionByName(rows.filter(~python))
    each = []
    for name, pattern, method, path, glob in patterns:
        said = F.when(F.lit(name == "nestjs-gateway"), "WS").otherwise(F.upper(F.regexp_extract("body", pattern, method)))
        route = F.regexp_extract("body", pattern, path)
        each.append(F.when(F.col("path").rlike(glob_to_regex(glob)) & F.col("body").rlike(pattern), F.struct(F.lit(name).alias("framework"), said.alias("method"), F.when(route == "", "/").otherwise(route).alias("route"))))
    found = rows.select("path", "line", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r"))
    return with_controllers(found.select("r.framework", "r.method", "r.route", "path", "line"), rows)


CONTROLLER = r"@Controller\s*\(\s*(?:['\"`]([^'\"`]*)['\"`])?"


def with_controllers(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Routes of decorators with the prefix of the controller whose class holds them: from its decorator to where its braces close."""
    about = rows.join(found.filter("framework = 'nestjs'").select("path").distinct(), "path", "left_semi")
    depth = F.size(F.split("body", r"\{")) - F.size(F.split("body", r"\}"))
    until = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    nested = about.withColumn("depth", F.sum(depth).over(until)).withColumn("opens", F.col("body").rlike(CONTROLLER))
    nested = nested.withColumn("c", F.max(F.when(F.col("opens"), F.struct(F.col("line").alias("at"), F.regexp_extract("body", CONTROLLER, 1).alias("prefix"), (F.col("depth") - depth).alias("base")))).over(until))
    # the class is over at the first line after its opening brace that is back at the depth of the decorator
    back = F.when((F.col("depth") <= F.col("c.base")) & depth.__lt__(0), F.col("line"))
    over = F.min(back).over(Window.partitionBy("path", "c.at").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    prefix = nested.filter("c is not null").withColumn("over", over).filter("over is null").select("path", "line", F.regexp_replace("c.prefix", "^/+|/+$", "").alias("prefix"))
    joined = found.join(prefix, ["path", "line"], "left")
    full = F.concat(F.lit("/"), F.col("prefix"), F.when(F.regexp_replace("route", "^/+", "") == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace("route", "^/+", ""))))
    route = F.when((F.col("framework") == "nestjs") & F.col("prefix").isNotNull() & (F.col("prefix") != ""), full).otherwise(F.col("route"))
    return joined.select("framework", "method", route.alias("route"), "path", "line")


#: Routes that a display shows of each framework.
SHOWN = 20


def routes_shown(found: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first most routes of each framework by path and line, with how many more there are."""
    whole, by = Window.partitionBy("framework"), Window.partitionBy("framework").orderBy("path", "line", "route")
    ranked = found.withColumn("r", F.row_number().over(by)).withColumn("more", F.greatest(F.count("*").over(whole) - most, F.lit(0).cast("long")))
    return ranked.filter(F.col("r") <= most).drop("r")
