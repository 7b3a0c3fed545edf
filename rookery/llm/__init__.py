"""Text preparation for training corpora: ten operators over documents, pages and conversations."""
