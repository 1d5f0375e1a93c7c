"""Frozen rule sets. Defaults are the shipped rules; override per job with ``replace``."""

from __future__ import annotations

from dataclasses import dataclass, field

from inkgate import fixed_values as fv


@dataclass(frozen=True)
class FormatRules:
    allowed_mime_types: tuple[str, ...] = fv.ALLOWED_MIME_TYPES
    disabled_mime_types: tuple[str, ...] = fv.DISABLED_MIME_TYPES
    disabled_extensions: tuple[str, ...] = fv.DISABLED_EXTENSIONS
    mime_to_extensions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(fv.MIME_TO_EXTENSIONS)
    )
    known_mismatches: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(fv.KNOWN_MISMATCHES)
    )
    max_file_size_mb: int = fv.MAX_FILE_SIZE_MB

    @property
    def max_file_size_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024


@dataclass(frozen=True)
class ExtractionRules:
    min_text_for_ocr: int = fv.MIN_TEXT_FOR_OCR
    min_usable_text: int = fv.MIN_USABLE_TEXT


@dataclass(frozen=True)
class ContentRules:
    min_chars: int = fv.MIN_CHARS
    ocr_char_threshold: int = fv.OCR_CHAR_THRESHOLD
    excerpt_len: int = fv.EXCERPT_LEN
    allowed_languages: tuple[str, ...] = fv.ALLOWED_LANGUAGES
    slm_confidence_threshold: float = fv.CONFIDENCE_THRESHOLD


@dataclass(frozen=True)
class DuplicateRules:
    cosine_similarity_threshold: float = fv.COSINE_THRESHOLD


@dataclass(frozen=True)
class EnrichmentRules:
    repeated_line_min_count: int = fv.REPEATED_LINE_MIN_COUNT
    max_enrichment_retries: int = fv.MAX_ENRICHMENT_RETRIES
    entity_excerpt_len: int = fv.ENTITY_EXCERPT_LEN
    gibberish_detection_enabled: bool = fv.GIBBERISH_DETECTION_ENABLED
    gibberish_short_token_ratio: float = fv.GIBBERISH_SHORT_TOKEN_RATIO
    gibberish_min_tokens: int = fv.GIBBERISH_MIN_TOKENS


@dataclass(frozen=True)
class GateRules:
    formats: FormatRules = field(default_factory=FormatRules)
    extraction: ExtractionRules = field(default_factory=ExtractionRules)
    content: ContentRules = field(default_factory=ContentRules)
    duplicates: DuplicateRules = field(default_factory=DuplicateRules)
    enrichment: EnrichmentRules = field(default_factory=EnrichmentRules)
