"""Readers and writers of mails, workbooks, folders and archives."""
