"""What kind of project each repository is.

Everything is read off file paths: the scan of the corpus for a profile reads no
content, except that of three manifest files at the root.  All signals become bits
or booleans that are combined map-side, so a repository with a third of all files
sends one small row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, parent, suffix
from ..functions.text import sql_string
from ..rules.catalog import CORE_DOMAINS, DOMAINS, OPTIONAL_DOMAINS
from .file_filters import project_files

# Language of a suffix.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React", ".tsx": "React/TS", ".java": "Java",
    ".kt": "Kotlin", ".swift": "Swift", ".c": "C", ".cpp": "C++", ".h": "C/C++ Header", ".rs": "Rust", ".go": "Go",
    ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".dart": "Dart", ".sol": "Solidity", ".m": "Objective-C",
    ".ino": "Arduino", ".sh": "Shell", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".toml": "TOML",
    ".tf": "Terraform", ".gradle": "Gradle", ".xml": "XML", ".html": "HTML", ".css": "CSS",
}
# File names that reveal a framework, in reporting order.
FRAMEWORKS = {
    "package.json": "Node.js", "next.config.js": "Next.js", "next.config.ts": "Next.js", "nuxt.config.js": "Nuxt.js",
    "angular.json": "Angular", "vue.config.js": "Vue.js", "svelte.config.js": "Svelte", "remix.config.js": "Remix",
    "astro.config.mjs": "Astro", "requirements.txt": "Python", "Pipfile": "Python/Pipenv", "pyproject.toml": "Python",
    "setup.py": "Python Package", "manage.py": "Django", "wsgi.py": "Django/Flask/WSGI", "asgi.py": "Django/ASGI",
    "app.py": "Flask/FastAPI", "main.py": "Python App", "Gemfile": "Ruby/Rails", "pom.xml": "Java/Maven",
    "build.gradle": "Android/Gradle", "build.gradle.kts": "Kotlin/Gradle", "go.mod": "Go Module",
    "Cargo.toml": "Rust", "composer.json": "PHP/Composer", "pubspec.yaml": "Flutter/Dart",
    "AndroidManifest.xml": "Android", "Info.plist": "iOS", "Podfile": "iOS/CocoaPods",
    "Podfile.lock": "iOS/CocoaPods", "google-services.json": "Android/Firebase",
    "GoogleService-Info.plist": "iOS/Firebase", "platformio.ini": "PlatformIO/Embedded",
    "CMakeLists.txt": "CMake/Embedded", "Makefile": "C/C++ Build", "sdkconfig": "ESP-IDF",
    "idf_component.yml": "ESP-IDF", "sketch.yaml": "Arduino", "model.py": "ML Model", "train.py": "ML Training",
    "inference.py": "ML Inference", "config.yaml": "ML Config", "environment.yml": "Conda/ML",
    "mlflow.yaml": "MLflow", ".github": "GitHub Actions", "Dockerfile": "Docker",
    "docker-compose.yml": "Docker Compose", "docker-compose.yaml": "Docker Compose", ".gitlab-ci.yml": "GitLab CI",
    "Jenkinsfile": "Jenkins", ".travis.yml": "Travis CI", "circle.yml": "CircleCI", ".circleci": "CircleCI",
    "k8s": "Kubernetes", "kubernetes": "Kubernetes", "helm": "Helm/K8s", "terraform": "Terraform",
    "main.tf": "Terraform", "serverless.yml": "Serverless Framework", "template.yaml": "AWS SAM",
    "samconfig.toml": "AWS SAM", "hardhat.config.js": "Hardhat/Solidity", "truffle-config.js": "Truffle/Solidity",
    "foundry.toml": "Foundry/Solidity",
}
# Words in a directory path that reveal a framework.
DIRECTORY_FRAMEWORKS = {"Kubernetes": ["kubernetes", "/k8s"], "Terraform": ["terraform"], "Helm": ["helm"]}
# Signals of an architecture type: file names, suffixes, or parts of a path.
ARCHITECTURES = {
    "android": ["AndroidManifest.xml", "build.gradle", "google-services.json", ".kt", ".java"],
    "ios": ["Info.plist", "Podfile", ".swift", ".m", "xcodeproj", "xcworkspace"],
    "flutter": ["pubspec.yaml", ".dart", "lib/main.dart"],
    "embedded": ["platformio.ini", "CMakeLists.txt", ".ino", "sdkconfig", "idf_component.yml", "sketch.yaml"],
    "ai_ml": ["model.py", "train.py", "inference.py", "environment.yml", "mlflow.yaml", ".ipynb"],
    "blockchain": ["hardhat.config.js", "truffle-config.js", ".sol", "foundry.toml"],
    "devops": ["Dockerfile", "docker-compose.yml", "Jenkinsfile", ".gitlab-ci.yml", "main.tf"],
    "web": ["package.json", "manage.py", "app.py", "pom.xml", "go.mod", "Cargo.toml"],
    "desktop": ["electron.js", "tauri.conf.json", "main.rs", ".exe", ".dmg"],
    "wearable": ["watchos", "watch_app", "wearable", "glasses", "ar_session", "ARSession", "VisionOS"],
}
# Words in a path that reveal a wearable project.
WEARABLE_WORDS = [
    "arkit", "arcore", "visionos", "watchkit", "watchos", "glasses", "rayban", "meta_glasses", "ar_session",
    "spatial_computing", "hololens", "openvr", "openxr",
]
# What activates the optional scan domains.
WEB_FRAMEWORKS = [
    "django", "flask/fastapi", "django/flask/wsgi", "django/asgi", "next.js", "nuxt.js", "angular", "vue.js",
    "svelte", "remix", "astro", "ruby/rails", "php/composer",
]
WEB_NAMES = ["app.py", "manage.py", "wsgi.py", "asgi.py"]
WEB_STARTS = ["pages/", "app/", "public/", "src/pages/"]
MOBILE_ARCHITECTURES = ["android", "ios", "flutter", "wearable"]
PIPELINE_NAMES = ["dockerfile", "docker-compose.yml", "docker-compose.yaml", "jenkinsfile", "main.tf"]
PIPELINE_STARTS = [".github/workflows/", ".gitlab-ci"]
PIPELINE_PARTS = ["terraform", "/k8s/", "kubernetes"]
AI_NAMES = ["model.py", "train.py", "inference.py", "mlflow.yaml", "environment.yml"]
AI_PACKAGES = ["langchain", "openai", "anthropic", "transformers", "torch", "tensorflow", "mlflow"]
MANIFESTS = ["requirements.txt", "pyproject.toml", "package.json"]
# Names of test files.
TEST_ENDS = ["_test.py", ".test.js", ".spec.js", ".test.ts", ".spec.ts"]


# The tests are SQL text rather than Column objects: there are some two hundred of
# them, and building each through the Python bridge takes longer than the query.


def _list(values: list[str]) -> str:
    return ", ".join(map(sql_string, values))


def _starts(column: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"startswith({column}, {sql_string(v)})" for v in values) + ")"


def _contains(column: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_string(v)})" for v in values) + ")"


def path_columns(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    named = files.select("repo_id", "path", name.alias("name"), suffix(name).alias("ext"), F.lower("path").alias("lpath"))
    return named.withColumns({"lname": F.lower("name"), "ldir": F.concat(F.lit("/"), parent(F.col("lpath")))})


def test_file_sql() -> str:
    """Is the file a test, judged by the path columns?"""
    ends = " OR ".join(f"endswith(lname, {sql_string(e)})" for e in TEST_ENDS)
    return f"({_starts('lpath', ['tests/', 'test/'])} OR contains(lpath, '/tests/') OR startswith(lname, 'test_') OR {ends})"


def architecture_sql() -> dict[str, str]:
    """One test per architecture type, over the path columns of a file."""

    def signal(text: str) -> str:
        low = text.lower()
        if low.startswith(".") and "/" not in low:
            return f"name = {sql_string(text)} OR lname = {sql_string(low)} OR ext = {sql_string(low)}"
        return f"contains(lpath, {sql_string(low)})"

    tests = {arch: " OR ".join(map(signal, signals)) for arch, signals in ARCHITECTURES.items()}
    tests["wearable"] += " OR " + _contains("lpath", WEARABLE_WORDS)
    return tests


def _bits(tests: list[str]) -> str:
    return " | ".join(f"IF({t}, {1 << i}L, 0L)" for i, t in enumerate(tests))


def _bit_of(names: list[str], column: str) -> str:
    table = ", ".join(f"{sql_string(n)}, {1 << i}L" for i, n in enumerate(names))
    return f"coalesce(element_at(map({table}), {column}), 0L)"


def _from_bits(mask: str, names: list[str]) -> str:
    """The names whose bit is set, in order."""
    return f"filter(array({_list(names)}), (x, i) -> ({mask} & shiftleft(1L, i)) <> 0)"


def repo_signals(files: DataFrame) -> DataFrame:
    """One row per repository: file count, languages, frameworks, architecture types and flags.

    Signals are combined per language first, so one pass over the paths serves all; the
    second step has as many rows per repository as it has languages.
    """
    names, labels = list(FRAMEWORKS), list(FRAMEWORKS.values())
    low, high = names[:32], names[32:]
    web = f"lname IN ({_list(WEB_NAMES)}) OR {_starts('lpath', WEB_STARTS)}"
    pipeline = f"lname IN ({_list(PIPELINE_NAMES)}) OR {_starts('lpath', PIPELINE_STARTS)} OR {_contains('lpath', PIPELINE_PARTS)}"
    table = F.expr(f"map({_list([x for pair in LANGUAGES.items() for x in pair])})")
    by_language = path_columns(files).groupBy("repo_id", F.element_at(table, F.col("ext")).alias("lang")).agg(
        F.count("*").alias("n"),
        F.min("path").alias("first_path"),
        F.expr(f"bit_or({_bit_of(low, 'name')} | {_bit_of(low, 'lname')})").alias("fw_low"),
        F.expr(f"bit_or({_bit_of(high, 'name')} | {_bit_of(high, 'lname')})").alias("fw_high"),
        F.expr(f"bit_or({_bits([_contains('ldir', w) for w in DIRECTORY_FRAMEWORKS.values()])})").alias("dir_bits"),
        F.expr(f"bit_or({_bits(list(architecture_sql().values()))})").alias("arch_bits"),
        F.expr(f"bool_or({web})").alias("web_files"),
        F.expr(f"bool_or({pipeline})").alias("pipeline_files"),
        F.expr(f"bool_or(lname IN ({_list(AI_NAMES)}))").alias("ai_files"),
        F.expr(f"bool_or({test_file_sql()})").alias("has_tests"),
    )
    bits, flags = ["fw_low", "fw_high", "dir_bits", "arch_bits"], ["web_files", "pipeline_files", "ai_files", "has_tests"]
    counted = by_language.groupBy("repo_id").agg(
        F.sum("n").alias("total_files"), _top_languages(F.col("lang").isNotNull()).alias("languages"),
        *[F.bit_or(b).alias(b) for b in bits], *[F.bool_or(f).alias(f) for f in flags],
    )
    by_name = f"{_from_bits('fw_low', labels[:32])}, {_from_bits('fw_high', labels[32:])}"
    types = _from_bits("arch_bits", list(ARCHITECTURES))
    return counted.select(
        "repo_id", "total_files", "has_tests",
        F.expr(f"array_distinct(concat({by_name}, {_from_bits('dir_bits', list(DIRECTORY_FRAMEWORKS))}))").alias("frameworks"),
        F.expr(f"IF(arch_bits <> 0, {types}, array('cli'))").alias("arch_types"),
        "web_files", "pipeline_files", "ai_files", "languages",
    )


def language_counts(files: DataFrame) -> DataFrame:
    """``(repo_id, lang, n, first_path)``."""
    table = F.expr(f"map({_list([x for pair in LANGUAGES.items() for x in pair])})")
    named = files.select("repo_id", "path", F.element_at(table, suffix(file_name(F.col("path")))).alias("lang"))
    return (
        named.where("lang IS NOT NULL")
        .groupBy("repo_id", "lang")
        .agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    )


def repo_languages(counts: DataFrame) -> DataFrame:
    """The ten commonest languages of each repository, ties by first path.

    There are fewer languages than suffixes in the table, so the list is short."""
    return counts.groupBy("repo_id").agg(_top_languages(F.lit(True)).alias("languages"))


def _top_languages(wanted: Column) -> Column:
    """Aggregate of ``(lang, n, first_path)`` rows: the ten commonest languages, in order."""
    listed = F.collect_list(F.when(wanted, F.struct((-F.col("n")).alias("k"), "first_path", "lang", "n")))
    return F.transform(F.slice(F.array_sort(listed), 1, 10), lambda x: F.struct(x["lang"].alias("lang"), x["n"].alias("n")))


def manifest_packages(files: DataFrame) -> DataFrame:
    """``(repo_id, ai_packages)``: does a root manifest name an AI package?"""
    return (
        files.where(F.col("path").isin(MANIFESTS))
        .groupBy("repo_id")
        .agg(F.expr(f"bool_or({_contains('lower(content)', AI_PACKAGES)})").alias("ai_packages"))
    )


def detected_domains(signals: DataFrame) -> DataFrame:
    """Add ``security_domains``: the core domains and the optional ones switched on."""
    overlap = "arrays_overlap({0}, array({1}))".format
    has = {
        "web": f"array_contains(arch_types, 'web') OR web_files OR {overlap('transform(frameworks, x -> lower(x))', _list(WEB_FRAMEWORKS))}",
        "mobile": overlap("arch_types", _list(MOBILE_ARCHITECTURES)),
        "embedded": "array_contains(arch_types, 'embedded')",
        "pipeline": "array_contains(arch_types, 'devops') OR pipeline_files",
        "ai_ml": "array_contains(arch_types, 'ai_ml') OR ai_files OR ai_packages",
    }
    optional = ", ".join(f"IF({has[d]}, {sql_string(d)}, NULL)" for d in OPTIONAL_DOMAINS)
    picked = f"filter(array({_list(CORE_DOMAINS)}, {optional}), x -> x IS NOT NULL)"
    return signals.withColumn("security_domains", F.expr(picked))


def apply_domain_config(profile: DataFrame, configs: DataFrame | None) -> DataFrame:
    """Add included domains, remove excluded ones, and list the optional ones left out."""
    domains = F.col("security_domains")
    if configs is not None:
        wanted = configs.select("repo_id", "include_domains", "exclude_domains")
        profile = profile.join(wanted, "repo_id", "left")
        empty = F.array().cast("array<string>")
        domains = F.array_union(domains, F.coalesce("include_domains", empty))
        domains = F.array_except(domains, F.coalesce("exclude_domains", empty))
    ordered = F.filter(F.array(*map(F.lit, DOMAINS)), lambda d: F.array_contains(domains, d))
    optional = F.array(*map(F.lit, OPTIONAL_DOMAINS))
    profile = profile.withColumn("security_domains", ordered).drop("include_domains", "exclude_domains")
    return profile.withColumn("skipped_domains", F.array_except(optional, "security_domains"))


def profile(files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """One row per repository: languages, frameworks, architecture, domains, counts."""
    kept = project_files(files)
    signals = (
        repo_signals(kept)
        .join(manifest_packages(files), "repo_id", "left")
        .withColumn("ai_packages", F.coalesce("ai_packages", F.lit(False)))
    )
    out = apply_domain_config(detected_domains(signals), configs)
    no_languages = F.array().cast("array<struct<lang:string,n:bigint>>")
    return out.select(
        "repo_id",
        F.coalesce("languages", no_languages).alias("languages"),
        F.coalesce(F.get("languages", F.lit(0))["lang"], F.lit("Unknown")).alias("primary_language"),
        "frameworks", "arch_types", "security_domains", "skipped_domains", "total_files", "has_tests",
    )
