"""The YAML request: a strict description of one run, checked before anything is planned."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from copy import deepcopy
from typing import Any

# Sections, fields and types of a request. A field that isn't
# listed is an error; what isn't given has its type's empty value.
_CHOICE = {"remove": bool, "normalize": bool}
FIELDS: dict[str, Any] = {
    "is_new": bool, "dataset_name": str, "username": str, "bible_id": str, "language_iso": str, "alt_language": str, "priority": int, "notify_ok": list, "notify_err": list,
    "output": {"directory": str, "csv": bool, "json": bool, "parquet": bool},
    "testament": {"nt": bool, "nt_books": list, "ot": bool, "ot_books": list},
    "database": {"remote": str, "file": str},
    "audio_data": {"catalog": {"mp3_64": bool, "mp3_16": bool, "opus": bool, "set_type_code": str}, "file": str, "remote": str, "post": str, "no_audio": bool},
    "text_data": {"catalog": {"text_usx_edit": bool, "text_plain_edit": bool, "text_plain": bool}, "file": str, "remote": str, "post": str, "no_text": bool},
    "timestamps": {"catalog": bool, "line_aligner": bool, "ts_bucket": bool, "fa_verse": bool, "fa_align": bool, "no_timestamps": bool},
    "training": {
        "redo_training": bool, "no_training": bool,
        "adapter": {"batch_mb": int, "num_epochs": int, "learning_rate": float, "warmup_pct": float, "grad_norm_max": float},
        "word_model": {"batch_mb": int, "num_epochs": int, "learning_rate": float, "warmup_pct": float, "grad_norm_max": float, "min_audio_sec": float},
    },
    "speech_to_text": {"base_asr": bool, "adapter_asr": bool, "word_asr": bool, "whisper": {"model": {"large": bool, "medium": bool, "small": bool, "base": bool, "tiny": bool}}, "asr_align": bool, "no_speech_to_text": bool},
    "detail": {"lines": bool, "verses": bool, "words": bool},
    "audio_encoding": {"mfcc": bool, "no_encoding": bool},
    "text_encoding": {"fast_text": bool, "no_encoding": bool},
    "audio_proof": {"html_report": bool, "base_dataset": str},
    "compare": {
        "html_report": bool, "base_dataset": str, "pattern_filter": int,
        "compare_settings": {
            "lower_case": bool, "remove_prompt_chars": bool, "remove_punctuation": bool, "double_quotes": _CHOICE, "apostrophe": _CHOICE, "hyphen": _CHOICE,
            "diacritical_marks": {"remove": bool, "normalize_nfc": bool, "normalize_nfd": bool, "normalize_nfkc": bool, "normalize_nfkd": bool},
        },
    },
}
#: Sections in which one option at most may be set, and the option taken if none is.
ONE_OF = {
    "audio_data": "no_audio", "text_data": "no_text", "timestamps": "no_timestamps", "speech_to_text": "no_speech_to_text",
    "audio_encoding": "no_encoding", "text_encoding": "no_encoding",
}
_NOT_COUNTED = {"set_type_code"}
DEFAULT_EPOCHS = 16

Request = dict[str, Any]


class RequestError(ValueError):
    """All that is wrong with a request, one line each; ``code`` is that of a status (REQ-14)."""

    code = 400

    def __init__(self, messages: list[str]):
        super().__init__("\n".join(messages))
        self.messages = messages


def _filled(spec: Any, given: Any, path: str, wrong: list[str]) -> Any:
    if isinstance(spec, dict):
        if given is not None and not isinstance(given, Mapping):
            wrong.append(f"{path}: expected a section")
            given = None
        given = given or {}
        wrong += [f"{path + '.' if path else ''}{k}: unknown field" for k in given if k not in spec]
        return {k: _filled(v, given.get(k), f"{path}.{k}" if path else k, wrong) for k, v in spec.items()}
    if given is None:
        return spec()
    if spec is float and isinstance(given, int) and not isinstance(given, bool):
        return float(given)
    if spec is str and isinstance(given, (int, float)) and not isinstance(given, bool):
        return str(given)
    if not isinstance(given, spec) or spec is int and isinstance(given, bool):
        wrong.append(f"{path}: expected {spec.__name__}")
        return spec()
    return given


def _chosen(section: Mapping[str, Any], recurse: bool = True) -> list[str]:
    """Names of the options that are set; a group of numbers counts once."""
    out = []
    for k, v in section.items():
        if k in _NOT_COUNTED:
            continue
        if isinstance(v, Mapping):
            inner = _chosen(v) if recurse else []
            numbers = [n for n in inner if not isinstance(v.get(n), (bool, str)) and n in v]
            out += ([k] if numbers else []) + [n for n in inner if n not in numbers]
        elif v:
            out.append(k)
    return out


def _rules(r: Request) -> list[tuple[bool, str]]:
    """Conditions across sections that make a request impossible (REQ-04)."""
    ts, stt, proof = r["timestamps"], r["speech_to_text"], r["audio_proof"]
    no_audio, no_text, wants_ts = r["audio_data"]["no_audio"], r["text_data"]["no_text"], not ts["no_timestamps"]
    estimated = ts["line_aligner"] or ts["fa_verse"] or ts["fa_align"]
    return [
        (bool(r["database"]["remote"]) and r["is_new"], "a remote database can't be new"),
        (wants_ts and no_audio, "timestamps need audio"),
        (wants_ts and no_text and not ts["catalog"], "timestamps need text"),
        (estimated and no_text, "estimated timestamps need text"),
        (not r["text_encoding"]["no_encoding"] and no_text, "text encoding needs text"),
        (not stt["no_speech_to_text"] and no_audio, "speech to text needs audio"),
        (r["audio_encoding"]["mfcc"] and not wants_ts, "audio encoding needs timestamps"),
        (proof["html_report"] and r["is_new"] and not ts["fa_align"], "an audio proof of a new dataset needs fa_align"),
        (proof["html_report"] and r["is_new"] and not stt["base_asr"], "an audio proof of a new dataset needs base_asr"),
        (proof["html_report"] and not r["is_new"] and not proof["base_dataset"], "an audio proof of an existing dataset needs base_dataset"),
    ]


def check(given: Mapping[str, Any], names: Mapping[str, str] | None = None) -> Request:
    """A complete request, or a RequestError with everything that is wrong (REQ-01..05).

    ``names`` renames fields of requests written for other programs (other
    name to the name here) before they are checked, at any depth.
    """

    def renamed(x):
        return {(names or {}).get(k, k): renamed(v) for k, v in x.items()} if isinstance(x, Mapping) else x

    wrong: list[str] = []
    r = _filled(FIELDS, renamed(given), "", wrong)
    wrong += [f"{f}: required" for f in ("dataset_name", "username") if not r[f]]
    if not r["bible_id"] and not r["language_iso"]:
        wrong.append("bible_id or language_iso: required")
    if not any(r["testament"].values()):
        r["testament"] |= {"nt": True, "ot": True}
    for section, default in ONE_OF.items():
        chosen = _chosen(r[section])
        if len(chosen) > 1:
            wrong.append(f"{section}: only one option can be set, not {', '.join(chosen)}")
        if not chosen:
            r[section][default] = True
    training = _chosen({k: v for k, v in r["training"].items() if k != "redo_training"})
    if len(training) > 1:
        wrong.append(f"training: only one option can be set, not {', '.join(training)}")
    if not training:
        r["training"]["no_training"] = True
    if not r["training"]["no_training"] and not any(r["training"][m]["num_epochs"] for m in ("adapter", "word_model")):
        r["training"]["adapter"]["num_epochs"] = DEFAULT_EPOCHS
    if not any(r["detail"].values()):
        r["detail"]["lines"] = True
    if r["timestamps"]["fa_align"]:
        r["detail"]["words"] = True
    for name, section in r["compare"]["compare_settings"].items():
        if isinstance(section, dict) and sum(section.values()) > 1:
            wrong.append(f"compare.compare_settings.{name}: only one option can be set")
    wrong += [text for broken, text in _rules(r) if broken]
    if wrong:
        raise RequestError(wrong)
    r["bible_id"] = r["bible_id"].upper()
    r["language_iso"] = (r["language_iso"] or r["bible_id"][:3]).lower()
    for k in ("nt_books", "ot_books"):
        r["testament"][k] = [str(b).upper() for b in r["testament"][k]]
    return r


def parse(text: str, names: Mapping[str, str] | None = None) -> Request:
    """A request of YAML text."""
    import yaml

    try:
        given = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RequestError([f"not YAML: {e}"]) from e
    if not isinstance(given, Mapping):
        raise RequestError(["a request is a mapping"])
    return check(given, names)


def encode(request: Request) -> str:
    """YAML of a request without its empty fields (JSN-02)."""
    import yaml

    def kept(x):
        return {k: y for k, v in x.items() if (y := kept(v) if isinstance(v, dict) else v)}

    return yaml.safe_dump(kept(deepcopy(request)), sort_keys=False, allow_unicode=True)


def option(section: Mapping[str, Any], table: Mapping[str, str]) -> str:
    """What the option that is set stands for; '' if none is (REQ-05)."""
    flat = set(_chosen(section))
    return next((v for k, v in table.items() if k in flat), "")


# Audio and text kinds of catalog entries.
AUDIO_KINDS = {"mp3_64": "MP3 64kbps", "mp3_16": "MP3 16kbps", "opus": "OPUS 16kbps"}
TEXT_KINDS = {"text_usx_edit": "text_usx", "text_plain_edit": "text_plain", "text_plain": "text_plain"}


def in_testament(request: Request, testament: str, book: str) -> bool:
    """Whether a book was asked for (PRJ-21): by its testament as a whole, or by name."""
    t = request["testament"]
    kind = testament.lower()
    return bool(kind in ("ot", "nt") and (t[kind] or book.upper() in t[f"{kind}_books"]))


def cleanup_options(request: Request) -> dict[str, Any]:
    """Options of :func:`quillstream.functions.text.cleanup` that a request's comparison asks for."""
    s = request["compare"]["compare_settings"]
    how: Callable[[dict], str] = lambda c: "remove" if c["remove"] else "normalize" if c["normalize"] else "keep"
    return {
        "lower": s["lower_case"], "prompts": s["remove_prompt_chars"], "punctuation": s["remove_punctuation"],
        "double_quotes": how(s["double_quotes"]), "apostrophes": how(s["apostrophe"]), "hyphens": how(s["hyphen"]),
    }


def unicode_form(request: Request) -> str:
    """NFC, NFD, NFKC, NFKD, ``strip`` or '' (STR-02)."""
    m = request["compare"]["compare_settings"]["diacritical_marks"]
    return "strip" if m["remove"] else next((f for f in ("NFC", "NFD", "NFKC", "NFKD") if m[f"normalize_{f.lower()}"]), "")
