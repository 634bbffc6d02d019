"""Relational operators; each module holds one problem or one family."""
