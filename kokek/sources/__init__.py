"""Readers and writers of lexicons, texts and gold analyses."""
