"""Names, patterns and limits that results depend on."""

from __future__ import annotations

# Classification of archive members.
SAFE_STEMS = "chat user message_feedback model_comparisons shared_conversations group_chats shopping sora settings files attachments media manifest index export_metadata asset_manifest"
RISK_EXTENSIONS = "pem key p12 pfx env kdbx ovpn sqlite db csv txt html json pdf docx xlsx"
MEDIA_EXTENSIONS = "png jpg jpeg webp gif bmp heic svg mp3 wav m4a ogg mp4 mov webm aac flac"
ATTACHMENT_EXTENSIONS = "pdf doc docx xls xlsx csv tsv ppt pptx txt zip 7z rar"
PAYLOAD_EXTENSIONS = "dat bundle"
SENSITIVE_NAME = r"password|secret|credential|token|backup.?code|recovery|auth|private.?key|\.env(?:\.|$)"
CONVERSATION_NAME = r"conversations?(?:[-_]?[0-9]+)?\.json"
SHARD_NAME = r"conversations(?:[_-]([0-9]+))?\.json"
RISK_CONTAINER, RISK_NAME, RISK_PATH, RISK_ENCRYPTED = "potential-private-content-container", "sensitive-name-pattern", "unsafe-extraction-path", "encrypted-entry"

# Bounded reads, in bytes.
SAMPLE_BYTES, ANCILLARY_BYTES, HEADER_BYTES = 65_536, 2_048, 64
MAX_ELEMENT_BYTES, MAX_DEPTH = 64 * 1024 * 1024, 256
TIMESTAMP_RANGE = (-62_135_596_800, 253_402_300_799)
SAMPLE_TIME_RANGE = (946_684_800, 4_102_444_800)
FREE_DISK_FLOOR = 2 * 1024**3

# What the structural index admits.
ROLES = "system developer user assistant tool function"
CONTENT_TYPES = (
    "text multimodal_text image audio audio_asset_pointer input_audio input_audio_transcription audio_transcription text_audio "
    "video video_frame real_time_user_audio_video computer_output execution_output tether_browsing_display code reasoning_recap "
    "thoughts app_pairing_content refusal review notification juicepred"
)
REFERENCE_KEYS = "asset_pointer file_id attachment_id image_url audio_url video_url"
CONTEXT_KEYS = "attachments files file attachment"
IN_CONTEXT_KEYS = "id url path"
REFERENCE_PREFIXES = ("sediment://", "file-service://", "attachment://")
RESOLUTIONS = "resolved ambiguous candidate_filename_join unresolved"
METHODS = "exact_zip_path explicit_aux_alias explicit_manifest_mapping explicit_mapping_candidates unverified_filename_join none"

# What the bounded schema sample admits.
SAMPLE_ROLES = "system user assistant tool developer"
SAMPLE_CONTENT_TYPES = "text multimodal_text image_asset_pointer audio audio_perception audio_text video code execution_output tether_browsing_display system_error"
SAMPLE_KEYS = (
    "id title create_time update_time mapping current_node message parent children author role name metadata recipient channel content "
    "content_type parts status end_turn weight attachments asset_pointer image_asset_pointer audio_asset_pointer video_asset_pointer width "
    "height size mime_type file_id file_name filename url is_visually_hidden_from_conversation conversation_id gizmo_id is_archived "
    "is_starred default_model_slug model_slug finish_details type citations content_references request_id timestamp start_time end_time "
    "files assets data mimeType original_name path asset_id file_size conversations version export_date sha256 sha1 mime content_hash "
    "original_filename file_path relative_path local_path attachment_id"
)

# Report families of header formats.
MEDIA_FAMILY = ("JPEG", "PNG", "WebP", "WAV", "ID3 audio candidate", "MPEG audio candidate", "ISO-BMFF media container")
DOCUMENT_FAMILY = ("PDF", "ZIP-family container", "OLE compound document", "SQLite", "gzip container")

# Integers that every conversation has, and versions.
METRICS = "nodes messages null_nodes roots branch_points extra_branches leaves active_valid active_nodes alternative_nodes unclassified_path_nodes cycle_nodes"
INDEX_VERSION, SCHEMA_VERSION = "phase2-1.0", "1.0"


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())
