"""The note rule set: fields, their order and types, markers, patterns, targets.

``load_rules`` reads an edited rule set from YAML with the same keys as
``Rules``; without a file these defaults hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Field names, in order, with their types; whether they are required.
FIELDS = (
    ("participant_id", "string", True),
    ("date_of_service", "date", True),
    ("duration_minutes", "integer", True),
    ("service_type", "string", True),
    ("goal_linkage", "string", True),
    ("location", "string", True),
    ("staff_presented_by", "string", True),
    ("participant_present", "boolean", True),
    ("narrative_summary", "string", True),
    ("billable_evidence", "string", True),
    ("outcomes_achieved", "array_of_strings", True),
    ("risk_management", "string", False),
    ("follow_up_needed", "boolean", True),
    ("follow_up_notes", "string", False),
)
# The options of service_type.
SERVICE_TYPES = (
    "Assistance with Daily Life",
    "Assistance with Social, Economic and Community Participation",
    "Development of Daily Living and Life Skills",
    "Group and Centre Based Activities",
    "Transport",
    "Short Term Accommodation and Assistance",
    "Support Coordination",
    "Specialist Support Coordination",
    "Therapy Supports",
    "Consumables",
    "Other",
)
# Gaps.
GAP_MARKER = "[not recorded]"
GAP_WORDS = ("", "[not recorded]", "[missing]", "n/a", "none", "unknown")
DURATION_GAP = -1
# Strata.
STRATA = ("routine_session", "incident", "capacity_building", "sparse_input", "adv_pii_check", "adv_missing_field")
GAP_STRATA = ("sparse_input", "adv_missing_field")
SUITES = ("fabrication", "pii_leakage", "missing_element")
# Fields that scorers treat apart.
GROUNDED = ("duration_minutes", "date_of_service", "participant_id", "service_type")
NOT_SCANNED = ("date_of_service", "participant_id", "staff_presented_by", "duration_minutes")
NOT_SCRUBBED = ("date_of_service", "duration_minutes", "participant_present", "follow_up_needed")
# Patterns of personal data. Python's \b, \w and \d are Unicode's; (?U) says so to Java.
EMAIL = r"(?iU)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
ID_NUMBER = r"(?iU)NDIS[-\s]?\d{6,}"
PHONE_WIDE = r"(?U)\b(?:\+?61[ -]?|\(0\d\)\s?|0)\d(?:[ -]?\d){7,9}\b"
PHONE = r"(?U)\b(?:\+?61[ -]?|0)\d(?:[ -]?\d){7,9}\b"
BIRTH_DATE = r"(?iU)\b(?:0?[1-9]|3[01])(?:0?[1-9]|1[0-2])[/\-](?:19|20)\d{2}\b"
POSTCODE = r"(?U)\b\d{4}\b(?!\d)"
NAME_CUES = (
    "mum", "mother", "dad", "father", "parent", "brother", "sister", "sibling", "son", "daughter", "aunt", "uncle", "cousin", "grandma", "grandpa", "nan", "pop", "partner", "wife", "husband", "friend", "flatmate", "housemate", "neighbour", "neighbor", "carer", "caregiver", "guardian", "advocate", "coordinator", "worker", "staff", "teacher", "nurse", "gp", "doctor", "dr", "mr", "mrs", "ms", "miss", "sir",
)
TITLES = ("Dr", "Mr", "Mrs", "Ms", "Miss", "Prof")
FIRST_PERSON = ("i", "we", "my", "our", "me", "us")
FILLERS = ("um+", "uh+", "yeah", "gonna", "wanna", "kinda", "like,", "so,", "okay so", "right so")
REDACTED = "[redacted]"
# Gates (name, target, hard).
GATES = (
    ("structural_compliance", 0.98, False),
    ("professional_register", 0.95, False),
    ("strata_faithfulness", 0.98, False),
    ("strata_pii_clean", 1.0, False),
    ("strata_billable_evidence", 0.95, False),
    ("suite_fabrication", 1.0, True),
    ("suite_pii_leakage", 1.0, True),
    ("suite_missing_element", 1.0, True),
)
# Records of a generated set by stratum.
PLAN = {"routine_session": 100, "incident": 45, "capacity_building": 45, "sparse_input": 50, "adv_pii_check": 80, "adv_missing_field": 45}


@dataclass(frozen=True)
class Rules:
    fields: tuple = FIELDS
    order: tuple = tuple(f[0] for f in FIELDS)
    options: dict = field(default_factory=lambda: {"service_type": SERVICE_TYPES})
    hints: dict = field(default_factory=dict)  # by field: format and description, for readers

    @property
    def names(self) -> list[str]:
        return [f[0] for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f[0] for f in self.fields if f[2]]


def load_rules(path: str | None = None) -> Rules:
    """The rule set in a YAML file (required_fields: field, type, required, options; structure_order), or the default one."""
    if path is None:
        return Rules()
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    rows = data.get("required_fields", [])
    fields = tuple((r["field"], r.get("type", "string"), bool(r.get("required", False))) for r in rows)
    options = {r["field"]: tuple(r["options"]) for r in rows if r.get("options")}
    order = tuple(data.get("structure_order") or [f[0] for f in fields if f[2]])
    hints = {r["field"]: {k: r[k] for k in ("format", "description") if r.get(k)} for r in rows if r.get("format") or r.get("description")}
    return replace(Rules(), fields=fields, order=order, options=options, hints=hints)


@dataclass(frozen=True)
class Settings:
    """What a training or serving job is told; nothing here trains. Values of a YAML file win over these."""

    # Defaults of adapter, training and serving.
    lora: dict = field(default_factory=lambda: {"r": 16, "alpha": 32, "dropout": 0.05, "bias": "none", "task_type": "CAUSAL_LM", "target_modules": ["q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj"]})
    training: dict = field(
        default_factory=lambda: {
            "base_model_name": "Qwen3-8B",
            "base_model_path": None,
            "trust_remote_code": True,
            "qlora_bitwidth": 4,
            "batch_size": 2,
            "gradient_accumulation_steps": 8,
            "learning_rate": 2.0e-4,
            "num_epochs": 3,
            "warmup_ratio": 0.1,
            "weight_decay": 0.01,
            "max_seq_length": 2048,
            "fp16": True,
            "bf16": False,
            "optim": "paged_adamw_8bit",
        }
    )
    serving: dict = field(default_factory=lambda: {"tensor_parallel_size": 1, "gpu_memory_utilization": 0.9, "max_model_len": 2048, "dtype": "float16"})


def load_settings(path: str | None = None) -> Settings:
    """The settings of a YAML file with the sections lora, training and serving, over the defaults; a name that has no default is an error."""
    made = Settings()
    if path is None:
        return made
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    given = {k: data.get(k) or {} for k in ("lora", "training", "serving")}
    for section, values in given.items():
        if unknown := set(values) - set(getattr(made, section)):
            raise ValueError(f"unknown in {section}: {', '.join(sorted(unknown))}")
    return Settings(**{k: getattr(made, k) | v for k, v in given.items()})
