"""Column functions: tokenise, classify, normalise, slots, keys and displays. All are native expressions."""

from .columns import (
    classify,
    dictionary_tokens,
    display,
    equals_ignoring_case,
    is_hex_digits,
    is_type,
    jaccard,
    join_slots,
    let,
    match_length,
    normalize,
    parsed,
    placeholder,
    register,
    slot,
    slot_and_values,
    slots_of,
    slots_of_key,
    template_key,
    tokens,
    values,
    values_of,
)

__all__ = ["classify", "dictionary_tokens", "display", "equals_ignoring_case", "is_hex_digits", "is_type", "jaccard", "join_slots", "let", "match_length", "normalize", "parsed", "placeholder", "register", "slot", "slot_and_values", "slots_of", "slots_of_key", "template_key", "tokens", "values", "values_of"]
