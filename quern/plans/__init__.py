"""From program text to typed, stratified rules."""
