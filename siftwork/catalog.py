"""Role catalog: which role types exist and the words that identify them.

The keys, their order (= tie-break order), groups and the ``decisive`` flag are fixed; the vocabulary is
a *parameter*. ``default_catalog`` is the full vocabulary; ``read_catalog`` loads another one from a
table with the columns ``ord, key, label, grp, decisive, keywords`` (keywords joined with ``|``). A custom
role type is one more row with a smaller ``ord``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

GENERAL = "general"
GENERAL_LABEL = "General SWE"

# fixed values: picker groups in display order
GROUPS = [
    "Low-level & performance", "Systems & infrastructure", "AI & data", "Physical & scientific",
    "Products & apps", "Other engineering",
]


@dataclass(frozen=True)
class RoleType:
    ord: int
    key: str
    label: str
    grp: str
    decisive: bool
    keywords: tuple[str, ...]


# fixed values: key, label, group, decisive, vocabulary
_ROWS = [
    ("quantresearch", "Quant Research / Trading", "Low-level & performance", True, (
        "quantitative researcher", "quantitative research", "quantitative trader", "quantitative trading",
        "quantitative developer", "quantitative analyst", "quantitative strategist", "quant researcher", "quant research",
        "quant trader", "quant trading", "quant analyst", "alpha research", "systematic trading", "portfolio construction",
        "derivatives pricing", "stochastic",
    )),
    ("quant", "HFT / Quant engineering", "Low-level & performance", False, (
        "trading", "trader", "quant", "quantitative", "hft", "high frequency", "high-frequency", "market data",
        "market making", "market-making", "order book", "matching engine", "exchange connectivity", "hedge fund",
        "prop trading", "proprietary trading", "kernel bypass", "tick data",
    )),
    ("gpu", "GPU / Accelerators", "Low-level & performance", False, (
        "gpu", "cuda", "tensorrt", "triton", "rocm", "cudnn", "cutlass", "accelerator", "accelerated compute",
        "ai compiler", "ai compilers", "inference", "inference optimization", "kernel optimization", "gpu kernels",
        "tensor core", "deep learning computer architecture", "computer architecture", "ai inference", "npu", "tpu",
        "co design", "co-design", "developer technology", "hpc", "high performance computing",
        "high-performance computing",
    )),
    ("compilers", "Compilers / Runtimes", "Low-level & performance", False, (
        "compiler", "llvm", "mlir", "codegen", "code generation", "jit", "intermediate representation", "toolchain",
        "interpreter", "language runtime", "garbage collect", "static analysis", "parser", "type system", "linker",
    )),
    ("silicon", "Silicon / RTL / EDA", "Low-level & performance", False, (
        "rtl", "verilog", "systemverilog", "vhdl", "asic", "physical design", "design verification", "silicon",
        "chip design", "eda", "synthesis", "place and route", "dft", "analog design", "timing closure", "soc design",
    )),
    ("aerospace", "Aerospace / Avionics", "Physical & scientific", False, (
        "aerospace", "avionics", "spacecraft", "satellite", "launch vehicle", "propulsion", "orbital", "attitude control",
        "space systems", "astrodynamics",
    )),
    ("robotics", "Robotics / Autonomy", "Physical & scientific", False, (
        "robotics", "robot", "robotic", "autonomy", "autonomous", "self-driving", "robotaxi", "perception",
        "motion planning", "planning & controls", "planning and controls", "controls", "slam", "localization", "gnc",
        "guidance", "navigation", "ros", "ros 2", "ros2", "isaac sim", "drone", "uav", "flight software", "manipulation",
        "humanoid", "hardware in loop", "hardware-in-the-loop", "hardware-in-loop", "hil", "sensor fusion", "lidar",
        "teleoperation",
    )),
    ("cv", "Computer Vision", "AI & data", False, (
        "computer vision", "image processing", "object detection", "segmentation", "visual perception",
        "3d reconstruction", "photogrammetry", "pose estimation", "optical flow",
    )),
    ("graphics", "Graphics / Rendering", "Products & apps", False, (
        "graphics", "rendering", "renderer", "shader", "ray tracing", "raytracing", "rasteriz", "opengl", "vulkan",
        "directx", "metal api", "path tracing", "real-time rendering",
    )),
    ("gamedev", "Game Development", "Products & apps", False, (
        "game", "gameplay", "unreal", "unity", "game engine", "level design", "game systems",
    )),
    ("ar", "AR / VR / XR", "Products & apps", False, (
        "augmented reality", "virtual reality", "mixed reality", "spatial computing", "headset", "xr", "ar vr",
        "hand tracking", "eye tracking",
    )),
    ("compbio", "Computational Biology", "Physical & scientific", False, (
        "computational biology", "bioinformatics", "genomics", "genomic", "protein", "molecular dynamics",
        "drug discovery", "sequencing", "cheminformatics", "structural biology",
    )),
    ("fintech", "Fintech / Payments", "Other engineering", False, (
        "payments", "fintech", "banking", "ledger", "settlement", "risk engine", "fraud detection", "credit risk",
        "treasury", "clearing",
    )),
    ("security", "Security / AppSec", "Systems & infrastructure", False, (
        "security", "appsec", "infosec", "cryptography", "cryptographic", "penetration testing", "red team",
        "vulnerability", "threat detection", "malware", "zero trust", "identity and access", "secure enclave",
    )),
    ("perf", "Performance / Optimization", "Low-level & performance", False, (
        "performance", "optimization", "optimisation", "low latency", "low-latency", "latency", "profiling", "simd", "avx",
        "vectoriz", "efficiency", "performance-critical", "high-performance", "throughput", "cache-friendly",
        "cache locality", "microarchitecture", "lock-free", "nanosecond", "hot path", "real-time constraints", "parallel",
        "parallelism", "parallel computing", "parallel programming", "concurrent", "multicore", "multi-core",
        "multithreading", "multithreaded", "numa", "openmp", "mpi", "cpu", "instruction set", "memory bandwidth",
        "scalability",
    )),
    ("mlresearch", "ML Research", "AI & data", False, (
        "research scientist", "research intern", "machine learning research", "ai research", "research engineer",
        "publication", "novel architectures", "foundation model research",
    )),
    ("database", "Databases / Storage", "Systems & infrastructure", False, (
        "database", "databases", "storage engine", "database internals", "query engine", "query optimizer", "storage",
        "transaction", "indexing", "columnar", "olap", "oltp", "key-value store",
    )),
    ("networking", "Networking", "Systems & infrastructure", False, (
        "networking", "network engineer", "networking stack", "tcp", "rdma", "packet processing", "routing", "switching",
        "load balancer", "cdn", "dpdk", "ebpf", "protocol design",
    )),
    ("cloud", "Cloud / DevOps / SRE", "Systems & infrastructure", False, (
        "cloud", "sre", "site reliability", "devops", "kubernetes", "terraform", "observability", "ci cd",
        "platform engineering", "deployment", "provisioning", "incident response",
    )),
    ("data", "Data Engineering", "AI & data", False, (
        "data engineer", "data engineering", "data infrastructure", "data pipeline", "etl", "spark", "data warehouse",
        "streaming data", "kafka", "airflow", "data lake",
    )),
    ("datasci", "Data Science / Analytics", "AI & data", False, (
        "data science", "data scientist", "analytics", "business intelligence", "statistician", "experimentation",
        "ab testing", "a/b testing", "causal inference", "forecasting",
    )),
    ("ml", "ML / AI Infra", "AI & data", False, (
        "machine learning", "ml", "ai", "deep learning", "ml infrastructure", "ai infrastructure", "ai platform",
        "ml platform", "mlops", "llm", "training", "applied ml", "recommendation", "generative ai", "model serving",
        "fine-tuning", "rag", "embeddings", "reinforcement learning",
    )),
    ("devtools", "Developer Tools / Build", "Other engineering", False, (
        "developer tools", "developer experience", "build system", "bazel", "developer productivity", "sdk", "api design",
        "ide", "tooling engineer", "release engineering",
    )),
    ("qa", "QA / Test Automation", "Other engineering", False, (
        "qa engineer", "quality assurance", "test automation", "test engineer", "sdet", "validation engineer",
        "verification and validation", "automated testing",
    )),
    ("mobile", "Mobile", "Products & apps", False, (
        "ios", "android", "mobile", "swift", "kotlin", "react native", "flutter", "mobile app",
    )),
    ("frontend", "Frontend / Web", "Products & apps", False, (
        "frontend", "front-end", "front end", "web developer", "javascript", "typescript", "react", "vue", "angular",
        "css", "web app", "user interface", "design systems",
    )),
    ("fullstack", "Full-stack / Product", "Products & apps", False, (
        "full stack", "full-stack", "fullstack", "product engineer", "web application", "crud", "saas", "rails", "django",
        "node js",
    )),
    ("systems", "Systems / Infra", "Systems & infrastructure", False, (
        "distributed systems", "distributed system", "infrastructure", "infra", "systems software", "system software",
        "operating system", "kernel development", "kernel", "linux", "backend", "back-end", "platform",
        "large-scale systems", "consensus", "raft", "paxos", "rpc framework", "concurrency", "concurrency primitives",
        "scheduler", "microservices",
    )),
    ("hardware", "Embedded / Hardware", "Physical & scientific", False, (
        "embedded", "firmware", "fpga", "soc", "bare metal", "bare-metal", "rtos", "microcontroller", "board bring-up",
        "device driver", "hardware", "battery management", "power electronics", "pcb", "signal integrity",
    )),
    ("it", "IT / Support", "Other engineering", False, (
        "help desk", "helpdesk", "technical support", "it support", "system administrator", "sysadmin", "desktop support",
        "service desk",
    )),
]


def default_catalog() -> list[RoleType]:
    return [RoleType(i, key, label, grp, decisive, words) for i, (key, label, grp, decisive, words) in enumerate(_ROWS)]


def catalog_sql(catalog: list[RoleType] | None = None) -> str:
    """The catalog as a literal table; the text runs in Spark and in DuckDB."""
    rows = ",\n".join(
        f"({t.ord}, '{t.key}', '{t.label}', '{t.grp}', {str(t.decisive).lower()}, '{'|'.join(t.keywords)}')"
        for t in (catalog or default_catalog()))
    return f"SELECT * FROM (VALUES {rows}) AS t(ord, key, label, grp, decisive, keywords)"


def read_catalog(spark: SparkSession, path: str, most: int = 10_000) -> list[RoleType]:
    """Load a user's catalog table. It is configuration that becomes part of plans: a table of more than ``most`` rows is
    refused as a mistake."""
    rows = spark.read.parquet(path).orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a role catalog is configuration; this table has more than {most:,} rows")
    return [RoleType(r.ord, r.key, r.label, r.grp, bool(r.decisive), tuple(r.keywords.split("|"))) for r in rows]


def catalog_frame(spark: SparkSession, catalog: list[RoleType] | None = None) -> DataFrame:
    return spark.sql(catalog_sql(catalog))
