"""Plain brute-force versions of the contract results, for small tables."""
import re, hashlib
from collections import defaultdict
W=re.compile(r'[^\x20\x09-\x0D]+')
def lower(s): return ''.join(chr(ord(c)+32) if 'A'<=c<='Z' else c for c in s)
def op2(docs):
    S=[]
    for i,t in docs:
        w=W.findall(lower(t or '')); S.append({tuple(w[j:j+5]) for j in range(len(w)-4)} if len(w)>=5 else ({tuple(w)} if w else set()))
    inv=defaultdict(list)
    for x,s in enumerate(S):
        for g in s: inv[g].append(x)
    c=defaultdict(int)
    for l in inv.values():
        for a in range(len(l)):
            for b in range(a): c[l[b],l[a]]+=1
    par=list(range(len(S)))
    def f(x):
        while par[x]!=x: x=par[x]
        return x
    for (a,b),n in c.items():
        if 100*n>=80*(len(S[a])+len(S[b])-n):
            a,b=f(a),f(b)
            if a!=b: par[max(a,b)]=min(a,b)
    m={}
    for x,(i,_) in enumerate(docs): m[f(x)]=min(m.get(f(x),i),i)
    return sorted((i,len(S[x]),m[f(x)]) for x,(i,_) in enumerate(docs))
def op3(docs):
    first={}
    for i,t in docs:
        w=W.findall(t or '')
        for j in range(len(w)-12):
            k=tuple(w[j:j+13]); first[k]=min(first.get(k,i),i)
    out=[]
    for i,t in docs:
        w=W.findall(t or ''); rem=[False]*len(w)
        for j in range(len(w)-12):
            if first[tuple(w[j:j+13])]<i:
                for q in range(j,j+13): rem[q]=True
        out.append((i,len(w),sum(rem),hashlib.sha256(' '.join(x for x,r in zip(w,rem) if not r).encode()).hexdigest()))
    return sorted(out)
def op4(docs):
    out=[]
    for i,t in docs:
        t=t or ''; w=W.findall(t); cnt=defaultdict(int)
        for j in range(len(w)-4): cnt[tuple(w[j:j+5])]+=1
        rep=set()
        for j in range(len(w)-4):
            if cnt[tuple(w[j:j+5])]>1: rep|=set(range(j,j+5))
        seen=set(); d=0
        for l in t.split('\n'):
            if W.search(l) and l in seen: d+=1
            seen.add(l)
        out.append((i,len(w),sum(map(len,w)),sum(c in '#*$%&|<>' for c in t),d,len(rep),len(w)<10 or 100*len(rep)>20*len(w)))
    return sorted(out)
def op6(docs):
    L=200; n=defaultdict(int); D=[(i,(t or '').encode()) for i,t in docs]
    for i,b in D:
        for j in range(len(b)-L+1): n[hash(b[j:j+L])]+=1
    out=[]
    for i,b in D:
        cov=bytearray(len(b))
        for j in range(len(b)-L+1):
            if n[hash(b[j:j+L])]>1: cov[j:j+L]=b'\x01'*L
        spans=len(re.findall(b'\x01+',bytes(cov)))
        out.append((i,len(b),sum(cov),spans,hashlib.sha256(bytes(x for x,c in zip(b,cov) if not c)).hexdigest()))
    return sorted(out)
def op7(docs,items):
    R=re.compile('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'); idx=defaultdict(set); lens=set()
    for i,t in items:
        w=R.findall(lower(t or ''))
        if not w: continue
        m=min(13,len(w)); lens.add(m)
        for j in range(len(w)-m+1): idx[tuple(w[j:j+m])].add(i)
    out=[]
    for i,t in docs:
        w=R.findall(lower(t or '')); hit=[0]*len(w); its=set()
        for m in lens:
            for j in range(len(w)-m+1):
                s=idx.get(tuple(w[j:j+m]))
                if s: its|=s; hit[j:j+m]=[1]*m
        out.append((i,len(w),sum(hit),len(its),hashlib.sha256(','.join(sorted(map(str,its))).encode()).hexdigest(),sum(hit)>0 and 20*sum(hit)>=len(w)))
    return sorted(out)
def luhn(d):
    s=0
    for i,c in enumerate(reversed(d)):
        c=int(c)
        if i%2: c=c*2-(9 if c>4 else 0)
        s+=c
    return s%10==0
PAT={'email':r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+','ip':r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)','card':r'[0-9]([\x20-]?[0-9])+','phone':r'\+[0-9][\x20().0-9-]+[0-9]'}
def spans10(t):
    out=[]
    for q,(k,p) in enumerate(PAT.items()):
        for m in re.finditer(p,t or ''):
            v=m.group(); d=re.sub('[^0-9]','',v)
            if k=='ip' and any(int(x)>255 for x in v.split('.')): continue
            if k=='card' and not(12<=len(d)<=19 and luhn(d)): continue
            if k=='phone' and not 9<=len(d)<=15: continue
            out.append((m.start(),q,m.end(),k))
    return sorted(out)
def op10(docs):
    r=[]
    for i,t in docs:
        s=spans10(t); r.append((i,*[sum(x[3]==k for x in s) for k in PAT],hashlib.sha256(','.join(f'{x[3]}:{x[0]}:{x[2]}' for x in s).encode()).hexdigest()))
    return sorted(r)
