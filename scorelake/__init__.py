"""Table operators that turn ordered observations into clean, measured sequences."""
